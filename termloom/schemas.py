"""Table contracts and the fixed texts the dictionary sheets rely on.

Everything in the first part is a fixed value: names, sentences and lists that
stored data depends on. The second part only arranges them for the jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Columns of the seven tables, in storage order.
# --------------------------------------------------------------------------

CONCEPT_COLUMNS = """
caso_de_uso string, codigo_de_dominio string, nombre_del_dominio string,
codigo_del_subdominio string, nombre_del_subdominio string,
nombre_del_subdominio_omg string, concepto_de_negocio string,
termino_de_negocio string, codigo_de_entidad_del_dato string,
data_owner string, dato_critico string, personal string, sensible string,
definicion_de_negocio string, tipo_de_dato string,
indicadores_empleados_en_el_calculo string, logica_de_calculo string,
ejemplo_de_valores_del_entidad_del_dato string,
prioridad_del_entidad_de_dato string, indicador_dimension string,
periodicidad_de_generacion string, areas_usuarias_del_dato string,
validado_por_data_owner string,
responsable_de_la_actualizacion_en_el_diccionario_negocio string,
ingestion_date timestamp
"""

RULE_COLUMNS = """
iniciativa string, caso_de_uso string, id_regla_de_calidad string,
termino_de_negocio string, tabla_del_entidad_de_dato_omg string,
campo_del_entidad_de_dato_omg string, nombre_del_entidad_de_dato string,
descripcion_de_regla_de_calidad string, tipo_de_regla_de_calidad string,
cumplimiento_regla_de_calidad_core string,
principio_de_calidad_asociado string, umbral_superior double,
umbral_inferior double, periodicidad string, aplicacion string,
data_owner string, validado_por_data_owner string, ingestion_date timestamp
"""

TRACE_COLUMNS = """
iniciativa string, caso_de_uso string, codigo_de_entidad_del_dato string,
tabla_del_entidad_de_dato_omg string, campo_del_entidad_de_dato_omg string,
nombre_de_entidad_del_dato string, llave string, aplicativos string,
fuente_oficial string, compania string, esquema string,
tabla_en_fuente_oficial string, campo_en_fuente_oficial string,
personal string, sensible string,
fuentes_y_campos_necesarias_para_el_calculo_o_generacion_del_dato string,
ruta_u_origen_del_repositorio_servidor string, data_entry string,
periodicidad_de_actualizacion string, profundidad_de_datos string,
formato_del_dato string, longitud string, es_llave_primaria string,
data_owner string, data_custodian string, validado_por_data_custodian string,
fecha_de_actualizacion_en_el_diccionario_tecnico string,
actualizacion_realizada_en_el_diccionario_tecnico string,
motivo_de_actualizacion_en_el_diccionario_tecnico string,
responsable_de_la_actualizacion_en_el_diccionario_tecnico string,
ingestion_date timestamp
"""

CUSTOM_CONCEPT_COLUMNS = """
concepto_de_negocio string, termino_de_negocio string,
codigo_de_entidad_del_dato string, data_owner string, dato_critico string,
personal string, sensible string, definicion_de_negocio string,
prioridad_del_entidad_de_dato string, fecha_registro timestamp
"""

SILVER_COLUMNS = """
codigo_de_entidad_del_dato string, concepto_de_negocio string,
termino_de_negocio string, nombre_del_dominio string,
nombre_del_subdominio string, data_owner string, dato_critico string,
personal string, sensible string, prioridad_del_entidad_de_dato string,
id_regla_de_calidad string, descripcion_de_regla_de_calidad string,
principio_de_calidad_asociado string, umbral_superior double,
umbral_inferior double, tabla_en_fuente_oficial string,
campo_en_fuente_oficial string, aplicativo string, fuente_oficial string,
fecha_actualizacion_diccionario timestamp, is_custom_concept boolean,
ingestion_date timestamp
"""

QUALITY_REPORT_COLUMNS = """
nombre_del_dominio string, nombre_del_subdominio string,
total_conceptos bigint, total_datos_criticos bigint,
total_datos_personales bigint, total_datos_sensibles bigint,
total_reglas_calidad bigint, promedio_umbral_superior double,
promedio_umbral_inferior double, ultimo_procesamiento timestamp
"""

PRIORITY_SUMMARY_COLUMNS = """
nombre_del_dominio string, prioridad_del_entidad_de_dato string,
cantidad_conceptos bigint, ultimo_procesamiento timestamp
"""

# The explanatory sentence each sheet repeats in its key column.
CONCEPT_LEGEND = "Identificador único secuencial, asignado al Entidad de Dato por Data Officer"
RULE_LEGEND = "Identificador de Regla de Calidad"
TRACE_LEGEND = "Identificador único secuencial, asignado al Entidad de Dato por CDO"

# Sheet headers that do not equal their table column once cleaned.
TRACE_RENAMES = {
    "aplicativo_s": "aplicativos",
    "sensble": "sensible",
    "data_entry_si_no": "data_entry",
}

# Cell texts that mean "no value" (a spreadsheet reader's usual
# list, then NaT, which date columns leave behind).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null", "NaT",
)

# Spellings accepted as "yes", and the two stored answers.
YES_SPELLINGS = ("Sí", "SI", "si", "sí", "S")
YES, NO = "Sí", "No"

# What an empty cell means in the golden layer.
GOLDEN_DEFAULTS = {
    "nombre_del_dominio": "No Especificado",
    "nombre_del_subdominio": "No Especificado",
    "prioridad_del_entidad_de_dato": "Media",
    "dato_critico": NO,
    "personal": NO,
    "sensible": NO,
}

# Labels of the two "top groups" reports, and their length.
NO_DOMAIN, NO_PRINCIPLE = "Sin dominio", "Sin principio"
TOP_GROUPS = 10

# Choices offered when a concept is inserted.
PRIORITY_CHOICES = ("Alta", "Media", "Baja")
FLAG_CHOICES = ("SI", "NO")

# --------------------------------------------------------------------------
# Arrangement
# --------------------------------------------------------------------------


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def contract(columns: str) -> T.StructType:
    """Nullable schema from a ``name type, name type`` text; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CONCEPTS = contract(CONCEPT_COLUMNS)
RULES = contract(RULE_COLUMNS)
TRACE = contract(TRACE_COLUMNS)
CUSTOM_CONCEPTS = contract(CUSTOM_CONCEPT_COLUMNS)
SILVER = contract(SILVER_COLUMNS)
QUALITY_REPORT = contract(QUALITY_REPORT_COLUMNS)
PRIORITY_SUMMARY = contract(PRIORITY_SUMMARY_COLUMNS)

FLAGS = ("dato_critico", "personal", "sensible")
THRESHOLDS = ("umbral_superior", "umbral_inferior")
CODE = "codigo_de_entidad_del_dato"
TERM = "termino_de_negocio"
RULE_ID = "id_regla_de_calidad"
DOMAIN = "nombre_del_dominio"
SUBDOMAIN = "nombre_del_subdominio"
PRIORITY = "prioridad_del_entidad_de_dato"
STAMP = "ingestion_date"


@dataclass(frozen=True)
class Entity:
    """One of the three dictionary sheets and the rules for changing it."""

    table: str
    schema: T.StructType
    key: str
    legend: str
    renames: dict[str, str] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()
    insertable: tuple[str, ...] = ()
    updatable: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)


# The fields of the forms that insert and edit each sheet, and those
# that must be filled.
CONCEPT = Entity(
    table="conceptos_negocio",
    schema=CONCEPTS,
    key=CODE,
    legend=CONCEPT_LEGEND,
    insertable=(
        "caso_de_uso", DOMAIN, SUBDOMAIN, "concepto_de_negocio", TERM, CODE,
        "data_owner", "dato_critico", "personal", "sensible",
        "definicion_de_negocio", "tipo_de_dato", PRIORITY,
    ),
    updatable=(
        "concepto_de_negocio", TERM, DOMAIN, SUBDOMAIN, "data_owner",
        "tipo_de_dato", PRIORITY, "dato_critico", "definicion_de_negocio",
    ),
    required=(CODE, "concepto_de_negocio", TERM),
    choices={PRIORITY: PRIORITY_CHOICES, **dict.fromkeys(FLAGS, FLAG_CHOICES)},
)

RULE = Entity(
    table="reglas_calidad",
    schema=RULES,
    key=RULE_ID,
    legend=RULE_LEGEND,
    numbers=THRESHOLDS,
    insertable=(
        RULE_ID, TERM, "descripcion_de_regla_de_calidad", "tipo_de_regla_de_calidad",
        "principio_de_calidad_asociado", *THRESHOLDS, "data_owner",
    ),
    updatable=(
        TERM, "descripcion_de_regla_de_calidad", "tipo_de_regla_de_calidad",
        "principio_de_calidad_asociado", *THRESHOLDS,
    ),
    required=(RULE_ID, TERM),
)

LINEAGE = Entity(
    table="trazabilidad",
    schema=TRACE,
    key=CODE,
    legend=TRACE_LEGEND,
    renames=TRACE_RENAMES,
    insertable=(
        CODE, "nombre_de_entidad_del_dato", "aplicativos", "fuente_oficial",
        "tabla_en_fuente_oficial", "campo_en_fuente_oficial", "data_owner",
        "periodicidad_de_actualizacion",
    ),
    updatable=(
        "nombre_de_entidad_del_dato", "aplicativos", "fuente_oficial",
        "tabla_en_fuente_oficial", "campo_en_fuente_oficial", "data_owner",
        "periodicidad_de_actualizacion",
    ),
    required=(CODE,),
)

# Sheet rows that could not be read, with where they stand and why.
REJECTED_TABLE = "filas_rechazadas"
REJECTED = T.StructType(
    [
        T.StructField("tabla", T.StringType()),
        T.StructField("archivo", T.StringType()),
        T.StructField("linea", T.LongType()),
        T.StructField("motivo", T.StringType()),
        T.StructField("contenido", T.StringType()),
        T.StructField(STAMP, T.TimestampType()),
    ]
)

# (layer, table) -> contract
TABLES = {
    ("bronze", CONCEPT.table): CONCEPTS,
    ("bronze", RULE.table): RULES,
    ("bronze", LINEAGE.table): TRACE,
    ("bronze", "app_custom_concepts"): CUSTOM_CONCEPTS,
    ("bronze", REJECTED_TABLE): REJECTED,
    ("silver", "conceptos_calidad_trazabilidad"): SILVER,
    ("golden", "reporte_calidad_conceptos"): QUALITY_REPORT,
    ("golden", "resumen_prioridad_dominio"): PRIORITY_SUMMARY,
}
# Key of each bronze table: what decides where a row is stored.
KEYS = {
    CONCEPT.table: CONCEPT.key,
    RULE.table: RULE.key,
    LINEAGE.table: LINEAGE.key,
    "app_custom_concepts": CODE,
    REJECTED_TABLE: "tabla",
}
LAYERS = ("raw", "bronze", "silver", "golden")
