from .columns import (  # noqa: F401
    clean_text,
    content_spread,
    has_yes,
    latest_first,
    null_tokens,
    numeric_id,
    parse_number,
    plain_number,
    yes_no,
)
from .headers import header_name  # noqa: F401
