"""Column-name cleaning. Runs on names only, never on rows."""

from __future__ import annotations

import re
import unicodedata

# The signs that stand between words in a header, besides white space.
SEPARATORS = "/()[]-?#\xa0"
_BETWEEN_WORDS = re.compile(rf"[\s{re.escape(SEPARATORS)}]+")


def header_name(header: object) -> str:
    """``' Código de Entidad (del dato)'`` -> ``'codigo_de_entidad_del_dato'``.

    Lower case, one underscore for each run of blanks or of ``/ ( ) [ ] - ? #``,
    none at the ends, no accents. Other signs, such as ``.``, ``%`` and ``¿``, stay.
    """
    joined = _BETWEEN_WORDS.sub("_", str(header).strip().lower()).strip("_")
    return "".join(ch for ch in unicodedata.normalize("NFD", joined) if unicodedata.category(ch) != "Mn")
