"""The registered queries in SQL, written on their own for another engine."""

from __future__ import annotations

import re

from termloom.schemas import CONCEPT, LINEAGE, RULE

from .mapping import VIEWS, sql_view

CONCEPT_NAMES, RULE_NAMES, TRACE_NAMES = (list(e.schema.names) for e in (CONCEPT, RULE, LINEAGE))

YES_LIST = "('Sí', 'SI', 'si', 'sí', 'S')"
NULL_LIST = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
    "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', 'NaT')"
)
RUN = "timestamp '2026-01-01'"
CONCEPT_LEGEND = "'Identificador único secuencial, asignado al Entidad de Dato por Data Officer'"
TRACE_LEGEND = "'Identificador único secuencial, asignado al Entidad de Dato por CDO'"
RULE_LEGEND = "'Identificador de Regla de Calidad'"


def _number(text: str) -> str:
    plain = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"case when regexp_matches({text}, '{plain}') then try_cast({text} as double) end"


def _threshold(column: str) -> str:
    return _number(f"replace(replace({column}, ',', '.'), '%', '')")


def _id(column: str) -> str:
    return f"try_cast(regexp_extract({column}, '([0-9]+)$', 1) as bigint)"


def _token(column: str, name: str | None = None) -> str:
    return f"case when {column} not in {NULL_LIST} then {column} end as {name or column}"


def _yes(column: str) -> str:
    return f"coalesce(trim({column}) in {YES_LIST}, false)"


def _strip(text: str) -> str:
    return rf"nullif(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '')"


def _mean(column: str) -> str:
    """Rounded average over exact decimals; 0.0 when there is no value."""
    total = f"cast(sum(cast({column} as decimal(18,4))) as double)"
    return f"coalesce(round({total} / nullif(count({column}), 0), 4), 0.0)"


# What the insert batch holds and a concept takes.
INSERTED = (
    "codigo_de_entidad_del_dato", "concepto_de_negocio", "termino_de_negocio", "nombre_del_dominio",
    "nombre_del_subdominio", "data_owner", "prioridad_del_entidad_de_dato", "dato_critico",
)

# Building blocks, each a common table expression. Only those a query names,
# directly or through others, are put in front of it.
PARTS = {
    "b_rules": f"""
select * exclude (umbral_superior, umbral_inferior),
  {_threshold('umbral_superior')} as umbral_superior, {_threshold('umbral_inferior')} as umbral_inferior
from fx_rules""",
    "u_concepts": f"""
select * replace (trim(codigo_de_entidad_del_dato) as codigo_de_entidad_del_dato) from fx_concepts
where codigo_de_entidad_del_dato is not null and codigo_de_entidad_del_dato <> {CONCEPT_LEGEND}
  and trim(codigo_de_entidad_del_dato) <> ''""",
    "u_rules": f"""
select * replace (trim(termino_de_negocio) as termino_de_negocio) from b_rules
where id_regla_de_calidad is not null and id_regla_de_calidad <> {RULE_LEGEND} and trim(id_regla_de_calidad) <> ''""",
    "u_trace": f"""
select * replace (trim(codigo_de_entidad_del_dato) as codigo_de_entidad_del_dato),
  {_id('trim(codigo_de_entidad_del_dato)')} as id_num from fx_trace
where codigo_de_entidad_del_dato is not null and codigo_de_entidad_del_dato <> {TRACE_LEGEND}
  and trim(codigo_de_entidad_del_dato) <> ''""",
    "concepts_all": f"""
select codigo_de_entidad_del_dato, concepto_de_negocio, termino_de_negocio, nombre_del_dominio, nombre_del_subdominio,
  data_owner, dato_critico, personal, sensible, definicion_de_negocio, prioridad_del_entidad_de_dato,
  false as is_custom_concept, {_id('codigo_de_entidad_del_dato')} as id_num from u_concepts
union all
select codigo_de_entidad_del_dato, concepto_de_negocio, termino_de_negocio, null, null,
  data_owner, dato_critico, personal, sensible, definicion_de_negocio, prioridad_del_entidad_de_dato,
  true, null from fx_custom""",
    "wide": """
select c.*, r.id_regla_de_calidad, r.descripcion_de_regla_de_calidad, r.principio_de_calidad_asociado,
  r.umbral_superior, r.umbral_inferior, t.tabla_en_fuente_oficial, t.campo_en_fuente_oficial,
  t.aplicativos as aplicativo, t.fuente_oficial,
  try_cast(t.fecha_de_actualizacion_en_el_diccionario_tecnico as timestamp) as fecha_actualizacion_diccionario,
  t.id_num is not null as has_trace
from concepts_all c left join u_trace t on c.id_num = t.id_num
  left join u_rules r on c.termino_de_negocio = r.termino_de_negocio""",
    "g": f"""
select * replace (
  coalesce(nombre_del_dominio, 'No Especificado') as nombre_del_dominio,
  coalesce(nombre_del_subdominio, 'No Especificado') as nombre_del_subdominio,
  coalesce(prioridad_del_entidad_de_dato, 'Media') as prioridad_del_entidad_de_dato,
  case when {_yes('dato_critico')} then 'Sí' else 'No' end as dato_critico,
  case when {_yes('personal')} then 'Sí' else 'No' end as personal,
  case when {_yes('sensible')} then 'Sí' else 'No' end as sensible)
from wide""",
    "inserts_checked": """
select *,
  concat_ws(',', case when coalesce(codigo_de_entidad_del_dato, '') = '' then 'codigo_de_entidad_del_dato' end,
    case when coalesce(concepto_de_negocio, '') = '' then 'concepto_de_negocio' end,
    case when coalesce(termino_de_negocio, '') = '' then 'termino_de_negocio' end) as missing_fields,
  concat_ws(',', case when prioridad_del_entidad_de_dato not in ('', 'Alta', 'Media', 'Baja')
      then 'prioridad_del_entidad_de_dato' end,
    case when dato_critico not in ('', 'SI', 'NO') then 'dato_critico' end) as bad_values
from fx_inserts""",
    "rule_edits_checked": f"""
select * replace ({_number('umbral_superior')} as umbral_superior, {_number('umbral_inferior')} as umbral_inferior),
  concat_ws(',', case when coalesce(id_regla_de_calidad, '') = '' then 'id_regla_de_calidad' end,
    case when coalesce(termino_de_negocio, '') = '' then 'termino_de_negocio' end) as missing_fields,
  concat_ws(',', case when {_strip('umbral_superior')} is not null and {_number('umbral_superior')} is null
      then 'umbral_superior' end,
    case when {_strip('umbral_inferior')} is not null and {_number('umbral_inferior')} is null
      then 'umbral_inferior' end) as bad_values
from fx_rule_edits""",
    "new_concepts": "select "
    + ", ".join(
        f"{_strip(c)} as {c}" if c in INSERTED
        else f"{RUN} as {c}" if c == "ingestion_date"
        else f"cast(null as varchar) as {c}"
        for c in CONCEPT_NAMES
    )
    + " from inserts_checked where missing_fields = '' and bad_values = ''",
    "edits": f"""
select {_strip('codigo_de_entidad_del_dato')} as k, {_strip('concepto_de_negocio')} as concepto_de_negocio,
  {_strip('termino_de_negocio')} as termino_de_negocio, {_strip('nombre_del_dominio')} as nombre_del_dominio,
  {_strip('nombre_del_subdominio')} as nombre_del_subdominio, {_strip('data_owner')} as data_owner,
  {_strip('tipo_de_dato')} as tipo_de_dato, {_strip('prioridad_del_entidad_de_dato')} as prioridad_del_entidad_de_dato,
  {_strip('dato_critico')} as dato_critico, {_strip('definicion_de_negocio')} as definicion_de_negocio
from fx_updates qualify row_number() over (partition by {_strip('codigo_de_entidad_del_dato')} order by seq desc) = 1""",
    "stored": f"select {', '.join(CONCEPT_NAMES)} from fx_concepts",
    "updated": "select "
    + ", ".join(
        f"case when e.k is null then c.{c} else e.{c} end as {c}"
        if c in (
            "concepto_de_negocio", "termino_de_negocio", "nombre_del_dominio", "nombre_del_subdominio",
            "data_owner", "tipo_de_dato", "prioridad_del_entidad_de_dato", "dato_critico", "definicion_de_negocio",
        )
        else f"case when e.k is null then c.{c} else {RUN} end as {c}" if c == "ingestion_date"
        else f"c.{c}"
        for c in CONCEPT_NAMES
    )
    + " from stored c left join edits e on c.codigo_de_entidad_del_dato = e.k",
    "deleted_codes": """
select 'CRM' || lpad(regexp_extract(codigo_de_entidad_del_dato, '([0-9]+)$', 1), 9, '0') as k
from fx_custom where codigo_de_entidad_del_dato is not null""",
    "before": "select *, codigo_de_entidad_del_dato as k from stored",
    "after": """
select *, codigo_de_entidad_del_dato as k from (
  select * from updated u where not exists (select 1 from deleted_codes d where d.k = u.codigo_de_entidad_del_dato)
  union all select * from new_concepts)""",
    "diff_rows": """
select * exclude (n), cast(sum(n) as bigint) as n
from (select *, -1 as n from before union all select *, 1 as n from after)
group by all having sum(n) <> 0""",
    "paired": """
select k from diff_rows where k is not null group by k
having sum(case when n < 0 then -n else 0 end) = 1 and sum(case when n > 0 then n else 0 end) = 1""",
    "sheet_clean": f"""
select {_token('codigo_de_entidad_del_dato')}, {_token('fuente_oficial')},
  {_token('fecha_de_actualizacion_en_el_diccionario_tecnico')}, {_token('columna_desconocida')} from fx_sheet""",
    "per_code": f"""
select nombre_del_dominio, nombre_del_subdominio, codigo_de_entidad_del_dato, dato_critico, has_trace,
  id_regla_de_calidad is not null as has_rule,
  coalesce(trim(concepto_de_negocio) <> '' and trim(termino_de_negocio) <> '' and trim(definicion_de_negocio) <> '',
    false) as complete
from g where codigo_de_entidad_del_dato is not null""",
}

QUALITY_REPORT = f"""
select nombre_del_dominio, nombre_del_subdominio,
  count(distinct codigo_de_entidad_del_dato) as total_conceptos,
  count(distinct case when dato_critico = 'Sí' then codigo_de_entidad_del_dato end) as total_datos_criticos,
  count(distinct case when personal = 'Sí' then codigo_de_entidad_del_dato end) as total_datos_personales,
  count(distinct case when sensible = 'Sí' then codigo_de_entidad_del_dato end) as total_datos_sensibles,
  count(id_regla_de_calidad) as total_reglas_calidad,
  {_mean('umbral_superior')} as promedio_umbral_superior,
  {_mean('umbral_inferior')} as promedio_umbral_inferior, {RUN} as ultimo_procesamiento
from g group by 1, 2"""

LATEST = ", ".join(CONCEPT_NAMES)
NEWEST_ORDER = ", ".join(
    f"{c} desc nulls last" for c in ("ingestion_date", *[c for c in CONCEPT_NAMES if c != "ingestion_date"])
)
CONCEPT_CHANGES = LATEST
RULE_CHANGES, TRACE_CHANGES = ", ".join(RULE_NAMES), ", ".join(TRACE_NAMES)
RULE_UPDATES = {
    "termino_de_negocio": _strip("e.termino_de_negocio"),
    "descripcion_de_regla_de_calidad": _strip("e.descripcion_de_regla_de_calidad"),
    "tipo_de_regla_de_calidad": _strip("e.tipo_de_regla_de_calidad"),
    "principio_de_calidad_asociado": _strip("e.principio_de_calidad_asociado"),
    "umbral_superior": "e.umbral_superior",
    "umbral_inferior": "e.umbral_inferior",
}
NEW_RULE = {
    "id_regla_de_calidad": "'NR' || cast(seq as varchar)",
    **{c: v.replace("e.", "") for c, v in RULE_UPDATES.items()},
    "ingestion_date": RUN,
}
NEW_TRACE = {
    "codigo_de_entidad_del_dato": _strip("codigo_de_entidad_del_dato"),
    "nombre_de_entidad_del_dato": _strip("concepto_de_negocio"),
    "aplicativos": _strip("nombre_del_dominio"),
    "ingestion_date": RUN,
}


def _row(names: list[str], values: dict[str, str]) -> str:
    """A select list of all columns, null where no value is given."""
    return ", ".join(f"{values.get(c, 'null')} as {c}" for c in names)


# Columns of the trace contract that the sheet lacks.
TRACE_PADDING = (
    "iniciativa caso_de_uso tabla_del_entidad_de_dato_omg campo_del_entidad_de_dato_omg nombre_de_entidad_del_dato "
    "llave aplicativos compania esquema tabla_en_fuente_oficial campo_en_fuente_oficial personal sensible "
    "fuentes_y_campos_necesarias_para_el_calculo_o_generacion_del_dato ruta_u_origen_del_repositorio_servidor "
    "data_entry periodicidad_de_actualizacion profundidad_de_datos formato_del_dato longitud es_llave_primaria "
    "data_owner data_custodian validado_por_data_custodian actualizacion_realizada_en_el_diccionario_tecnico "
    "motivo_de_actualizacion_en_el_diccionario_tecnico responsable_de_la_actualizacion_en_el_diccionario_tecnico"
).split()

def _sheet(view: str, names: list[str], legend: str) -> str:
    """All columns of a sheet after cleaning; a row without any value is dropped."""
    def cleaned(c: str) -> str:
        if c == "ingestion_date":
            return f"{RUN} as {c}"
        return f"{_threshold(c)} as {c}" if c in ("umbral_superior", "umbral_inferior") else _token(c)

    key = next(c for c in ("id_regla_de_calidad", "codigo_de_entidad_del_dato") if c in names)
    return f"select {', '.join(map(cleaned, names))} from {view} where {key} is distinct from {legend}"


SHEET_RULES = _sheet("fx_rules", RULE_NAMES, RULE_LEGEND)

QUERIES = {
    "sheet_concepts": _sheet("fx_concepts", CONCEPT_NAMES, CONCEPT_LEGEND),
    "sheet_rules": SHEET_RULES,
    "sheet_trace": _sheet("fx_trace", TRACE_NAMES, TRACE_LEGEND),
    "stream_ingest": SHEET_RULES,
    "bronze_null_tokens": "select * from sheet_clean",
    "bronze_blank_rows": """
select * from sheet_clean where codigo_de_entidad_del_dato is not null or fuente_oficial is not null
  or fecha_de_actualizacion_en_el_diccionario_tecnico is not null or columna_desconocida is not null""",
    "bronze_thresholds": "select id_regla_de_calidad, umbral_superior, umbral_inferior from b_rules",
    "bronze_conform": f"""
select {", ".join(f"cast(null as varchar) as {c}" for c in TRACE_PADDING)}, codigo_de_entidad_del_dato,
  fuente_oficial, fecha_de_actualizacion_en_el_diccionario_tecnico, {RUN} as ingestion_date
from sheet_clean where codigo_de_entidad_del_dato is not null or fuente_oficial is not null
  or fecha_de_actualizacion_en_el_diccionario_tecnico is not null or columna_desconocida is not null""",
    "silver_filter_keys": """
select 'concepts' as tabla, codigo_de_entidad_del_dato as clave, termino_de_negocio from u_concepts
union all select 'rules', id_regla_de_calidad, termino_de_negocio from u_rules
union all select 'trace', codigo_de_entidad_del_dato, null from u_trace""",
    "silver_numeric_key": f"""
select codigo_de_entidad_del_dato, {_id('codigo_de_entidad_del_dato')} as id_num from u_concepts
union all select codigo_de_entidad_del_dato, id_num from u_trace""",
    "silver_union_custom": """
select codigo_de_entidad_del_dato, concepto_de_negocio, termino_de_negocio, nombre_del_dominio,
  nombre_del_subdominio, dato_critico, personal, sensible, prioridad_del_entidad_de_dato, is_custom_concept, id_num
from concepts_all""",
    "silver_join_trace": """
select c.codigo_de_entidad_del_dato, t.tabla_en_fuente_oficial, t.campo_en_fuente_oficial,
  t.aplicativos as aplicativo, t.fuente_oficial,
  try_cast(t.fecha_de_actualizacion_en_el_diccionario_tecnico as timestamp) as fecha_actualizacion_diccionario,
  t.id_num is not null as has_trace
from concepts_all c left join u_trace t on c.id_num = t.id_num""",
    "silver_join_rules": """
select codigo_de_entidad_del_dato, termino_de_negocio, id_regla_de_calidad, umbral_superior, umbral_inferior,
  tabla_en_fuente_oficial, has_trace from wide""",
    "silver_full": f"""
select codigo_de_entidad_del_dato, concepto_de_negocio, termino_de_negocio, nombre_del_dominio,
  nombre_del_subdominio, data_owner, dato_critico, personal, sensible, prioridad_del_entidad_de_dato,
  id_regla_de_calidad, descripcion_de_regla_de_calidad, principio_de_calidad_asociado, umbral_superior,
  umbral_inferior, tabla_en_fuente_oficial, campo_en_fuente_oficial, aplicativo, fuente_oficial,
  fecha_actualizacion_diccionario, is_custom_concept, {RUN} as ingestion_date from wide""",
    "golden_defaults": """
select codigo_de_entidad_del_dato, coalesce(nombre_del_dominio, 'No Especificado') as nombre_del_dominio,
  coalesce(nombre_del_subdominio, 'No Especificado') as nombre_del_subdominio,
  coalesce(prioridad_del_entidad_de_dato, 'Media') as prioridad_del_entidad_de_dato,
  coalesce(dato_critico, 'No') as dato_critico, coalesce(personal, 'No') as personal,
  coalesce(sensible, 'No') as sensible from concepts_all""",
    "golden_flags": f"""
select codigo_de_entidad_del_dato, case when {_yes('dato_critico')} then 'Sí' else 'No' end as dato_critico,
  case when {_yes('personal')} then 'Sí' else 'No' end as personal,
  case when {_yes('sensible')} then 'Sí' else 'No' end as sensible from concepts_all""",
    "golden_quality_report": QUALITY_REPORT,
    "golden_quality_report_eager": QUALITY_REPORT,
    "golden_quality_report_distinct_rules": QUALITY_REPORT.replace(
        "count(id_regla_de_calidad)", "count(distinct id_regla_de_calidad)"
    ),
    "golden_priority": f"""
select nombre_del_dominio, prioridad_del_entidad_de_dato,
  count(distinct codigo_de_entidad_del_dato) as cantidad_conceptos, {RUN} as ultimo_procesamiento
from g group by 1, 2""",
    "kpi_counts": """
select 'conceptos_negocio' as "table", count(*) as total from fx_concepts
union all select 'reglas_calidad', count(*) from fx_rules union all select 'trazabilidad', count(*) from fx_trace""",
    "top_domains": """
select coalesce(nombre_del_dominio, 'Sin dominio') as nombre_del_dominio, count(*) as total
from fx_concepts group by 1 order by 2 desc, 1 limit 10""",
    "top_principles": """
select coalesce(principio_de_calidad_asociado, 'Sin principio') as principio, count(*) as total
from fx_rules group by 1 order by 2 desc, 1 limit 10""",
    "latest_records": "select * from (select "
    + LATEST
    + " from fx_concepts) order by ingestion_date desc nulls last, "
    + ", ".join(f"{c} nulls last" for c in CONCEPT_NAMES if c != "ingestion_date")
    + " limit 50",
    "latest_records_all": f"select {LATEST} from fx_concepts order by ingestion_date desc nulls last",
    "change_insert": f"select {CONCEPT_CHANGES} from stored union all select {CONCEPT_CHANGES} from new_concepts",
    "change_insert_rules": f"""
select {RULE_CHANGES} from b_rules
union all select {_row(RULE_NAMES, NEW_RULE)}
from rule_edits_checked where bad_values = '' and coalesce(termino_de_negocio, '') <> ''""",
    "change_insert_trace": f"""
select {TRACE_CHANGES} from fx_trace
union all select {_row(TRACE_NAMES, NEW_TRACE)}
from fx_inserts where coalesce(codigo_de_entidad_del_dato, '') <> ''""",
    "change_update": f"select {CONCEPT_CHANGES} from updated",
    "change_update_rules": """
with last_edit as (select * from rule_edits_checked where bad_values = ''
  qualify row_number() over (partition by id_regla_de_calidad order by seq desc) = 1)
select """
    + ", ".join(
        f"case when e.seq is null then r.{c} else {({**RULE_UPDATES, 'ingestion_date': RUN})[c]} end as {c}"
        if c in RULE_UPDATES or c == "ingestion_date"
        else f"r.{c}"
        for c in RULE_NAMES
    )
    + " from b_rules r left join last_edit e on r.id_regla_de_calidad = e.id_regla_de_calidad",
    "change_update_trace": f"""
with last_edit as (select 'POL' || cast(cast(substr(trim(codigo_de_entidad_del_dato), 4) as bigint) as varchar) as k,
    {_strip('concepto_de_negocio')} as nombre_de_entidad_del_dato, 'APP' as aplicativos,
    {_strip('termino_de_negocio')} as fuente_oficial, 'T' as tabla_en_fuente_oficial,
    cast(null as varchar) as campo_en_fuente_oficial, {_strip('data_owner')} as data_owner,
    {_strip('prioridad_del_entidad_de_dato')} as periodicidad_de_actualizacion
  from fx_updates qualify row_number() over (partition by codigo_de_entidad_del_dato order by seq desc) = 1)
select """
    + ", ".join(
        f"case when e.k is null then t.{c} else {RUN if c == 'ingestion_date' else 'e.' + c} end as {c}"
        if c in (
            "nombre_de_entidad_del_dato", "aplicativos", "fuente_oficial", "tabla_en_fuente_oficial",
            "campo_en_fuente_oficial", "data_owner", "periodicidad_de_actualizacion", "ingestion_date",
        )
        else f"t.{c}"
        for c in TRACE_NAMES
    )
    + " from fx_trace t left join last_edit e on t.codigo_de_entidad_del_dato = e.k",
    "change_delete": f"""
select {LATEST} from fx_concepts c
where not exists (select 1 from deleted_codes d where d.k = c.codigo_de_entidad_del_dato)""",
    "change_delete_rules": f"""
select {RULE_CHANGES} from b_rules r where not exists (
  select 1 from fx_custom where 'RC' || cast(cast(regexp_extract(codigo_de_entidad_del_dato, '([0-9]+)$', 1) as bigint)
    as varchar) = r.id_regla_de_calidad)""",
    "change_delete_trace": f"""
select {TRACE_CHANGES} from fx_trace t where not exists (
  select 1 from fx_custom u where t.codigo_de_entidad_del_dato =
    'POL' || cast(cast(regexp_extract(u.codigo_de_entidad_del_dato, '([0-9]+)$', 1) as bigint) as varchar))""",
    "change_validate": """
select 'conceptos_negocio' as tabla, codigo_de_entidad_del_dato as clave, missing_fields, bad_values,
  missing_fields = '' and bad_values = '' as accepted from inserts_checked
union all select 'reglas_calidad', id_regla_de_calidad, missing_fields, bad_values,
  missing_fields = '' and bad_values = '' from rule_edits_checked""",
    "change_values": f"""
select seq, id_regla_de_calidad, termino_de_negocio, descripcion_de_regla_de_calidad, tipo_de_regla_de_calidad,
  nullif(principio_de_calidad_asociado, '') as principio_de_calidad_asociado, umbral_superior, umbral_inferior
from rule_edits_checked""",
    "dash_totals": """
select 'entities' as metric, count(distinct codigo_de_entidad_del_dato) as total from concepts_all
union all select 'domains', count(distinct nombre_del_dominio) from concepts_all
union all select 'subdomains', count(*) from (select distinct nombre_del_dominio, nombre_del_subdominio from concepts_all
  where nombre_del_dominio is not null and nombre_del_subdominio is not null)
union all select 'critical', count(distinct codigo_de_entidad_del_dato) from g where dato_critico = 'Sí'
union all select 'with_rule', count(distinct codigo_de_entidad_del_dato) from g where id_regla_de_calidad is not null
union all select 'with_trace', count(distinct codigo_de_entidad_del_dato) from g where has_trace""",
    "dash_flags_by_domain": " union all ".join(
        f"select nombre_del_dominio, '{flag}' as flag, "
        f"count(distinct case when {flag} = 'Sí' then codigo_de_entidad_del_dato end) as n from g "
        "where codigo_de_entidad_del_dato is not null group by nombre_del_dominio"
        for flag in ("dato_critico", "personal", "sensible")
    ),
    "dash_priority_share": """
select coalesce(prioridad_del_entidad_de_dato, 'Media') as prioridad_del_entidad_de_dato,
  count(distinct codigo_de_entidad_del_dato) as n,
  round(count(distinct codigo_de_entidad_del_dato) / (select count(distinct codigo_de_entidad_del_dato)
    from concepts_all), 4) as share
from concepts_all where codigo_de_entidad_del_dato is not null group by 1""",
    "dash_rules_by_principle": """
select coalesce(principio_de_calidad_asociado, 'Sin principio') as principio, nombre_del_dominio,
  count(distinct id_regla_de_calidad) as n
from g where id_regla_de_calidad is not null group by 1, 2""",
    "dash_completeness": """
with codes as (select nombre_del_subdominio, codigo_de_entidad_del_dato, max(complete) as a, max(has_rule) as b,
  max(has_trace) as d from per_code group by 1, 2)
select nombre_del_subdominio, count(*) as total, round(count_if(a) * 100 / count(*), 2) as pct_concepto,
  round(count_if(b) * 100 / count(*), 2) as pct_regla, round(count_if(d) * 100 / count(*), 2) as pct_trazabilidad,
  count(*) - count_if(a) as sin_concepto, count(*) - count_if(b) as sin_regla,
  count(*) - count_if(d) as sin_trazabilidad
from codes group by 1""",
    "dash_last_update": """
select 'conceptos_negocio' as "table", max(ingestion_date) as last_update from fx_concepts
union all select 'reglas_calidad', max(ingestion_date) from fx_rules
union all select 'trazabilidad', max(ingestion_date) from fx_trace""",
    "newest_rows": f"""
select {LATEST} from fx_concepts qualify codigo_de_entidad_del_dato is null
  or row_number() over (partition by codigo_de_entidad_del_dato order by {NEWEST_ORDER}) = 1""",
    "lineage_forward": f"""
with codes as (select distinct trim(codigo_de_entidad_del_dato) as codigo_de_entidad_del_dato from fx_concepts)
select distinct c.codigo_de_entidad_del_dato, t.fuente_oficial as sistema, t.esquema,
  t.tabla_en_fuente_oficial as tabla, t.campo_en_fuente_oficial as campo, t.aplicativos as aplicacion
from codes c join u_trace t on {_id('c.codigo_de_entidad_del_dato')} = t.id_num""",
    "lineage_reverse": f"""
with asked as (select distinct tabla_en_fuente_oficial as tabla, campo_en_fuente_oficial as campo from fx_trace)
select distinct a.tabla, a.campo, c.codigo_de_entidad_del_dato
from asked a join u_trace t on a.tabla is not distinct from t.tabla_en_fuente_oficial
    and a.campo is not distinct from t.campo_en_fuente_oficial
  join u_concepts c on {_id('c.codigo_de_entidad_del_dato')} = t.id_num""",
    "dedup_concepts": f"""
with trimmed as (select * replace (case when trim(codigo_de_entidad_del_dato) = '' then codigo_de_entidad_del_dato
    else trim(codigo_de_entidad_del_dato) end as codigo_de_entidad_del_dato) from fx_concepts)
select {LATEST} from trimmed qualify coalesce(trim(codigo_de_entidad_del_dato), '') = ''
  or row_number() over (partition by codigo_de_entidad_del_dato order by {NEWEST_ORDER}) = 1""",
    "snapshot_diff": "select p.k as codigo_de_entidad_del_dato, 'update' as change, cast(1 as bigint) as copies, "
    + "concat_ws(',', "
    + ", ".join(
        f"case when o.{c} is distinct from n.{c} then '{c}' end"
        for c in CONCEPT_NAMES if c != "codigo_de_entidad_del_dato"
    )
    + ") as changed_columns, "
    + ", ".join(f"o.{c} as before_{c}, n.{c} as after_{c}" for c in CONCEPT_NAMES)
    + """
from paired p join diff_rows o on o.k = p.k and o.n < 0 join diff_rows n on n.k = p.k and n.n > 0
union all
select k, case when n < 0 then 'delete' else 'insert' end, abs(n), '', """
    + ", ".join(f"case when n < 0 then d.{c} end, case when n > 0 then d.{c} end" for c in CONCEPT_NAMES)
    + " from diff_rows d where not exists (select 1 from paired p where p.k = d.k)",
    "diff_applied": f"select {LATEST} from after",
    "diff_reverted": f"select {LATEST} from before",
    "history": """
select *, ingestion_date as valid_from,
  case when codigo_de_entidad_del_dato is not null then lead(ingestion_date) over next_one end as valid_to,
  codigo_de_entidad_del_dato is null or lead(ingestion_date) over next_one is null as is_current
from fx_versions window next_one as (partition by codigo_de_entidad_del_dato order by ingestion_date nulls first,
  prioridad_del_entidad_de_dato nulls first, peso nulls first, event_id nulls first)""",
    "history_as_of": """
select * from fx_versions where ingestion_date <= timestamp '2024-01-15'
qualify codigo_de_entidad_del_dato is null or row_number() over (partition by codigo_de_entidad_del_dato
  order by ingestion_date desc, prioridad_del_entidad_de_dato desc, peso desc, event_id desc) = 1""",
    "job_golden_report": QUALITY_REPORT,
}
_MARKED = "(select *, event_id % 13 = 0 as fin from fx_versions)"
QUERIES["history_ended"] = f"select * from ({QUERIES['history'].replace('fx_versions', _MARKED + ' v')}) where not fin"
QUERIES["history_as_of_many"] = f"""
with asked as (select row_number() over () as nr, event_id as peticion, codigo_de_entidad_del_dato as k,
    ingestion_date + to_hours(event_id % 3) as momento from fx_versions),
  found as (select * from asked a left join {_MARKED} v
    on v.codigo_de_entidad_del_dato = a.k and v.ingestion_date <= a.momento
    qualify row_number() over (partition by nr order by v.ingestion_date desc nulls last,
      v.prioridad_del_entidad_de_dato desc nulls last, v.peso desc nulls last, v.event_id desc nulls last) = 1)
select peticion, k as codigo_de_entidad_del_dato, momento,
  case when not fin then prioridad_del_entidad_de_dato end as prioridad_del_entidad_de_dato,
  case when not fin then peso end as peso, case when not fin then event_id end as event_id,
  case when not fin then ingestion_date end as ingestion_date from found"""
QUERIES["job_dashboard_totals"] = QUERIES["dash_totals"]
QUERIES["job_dashboard_completeness"] = QUERIES["dash_completeness"]
QUERIES["change_validate_trace"] = """
select codigo_de_entidad_del_dato as clave, nombre_del_dominio as aplicativos,
  coalesce(codigo_de_entidad_del_dato, '') <> '' as accepted,
  case when coalesce(codigo_de_entidad_del_dato, '') = '' then 'codigo_de_entidad_del_dato' else '' end as missing_fields,
  '' as bad_values from fx_inserts"""
QUERIES["log_replayed"] = QUERIES["diff_applied"]
QUERIES["log_rolled_back"] = f"select {LATEST} from updated"
QUERIES["log_folded"] = QUERIES["snapshot_diff"]

# The golden tables over the tables after the batches: the same parts, on other tables.
_CHANGED = {"fx_concepts": "concepts_new", "b_rules": "rules_new", "fx_trace": "trace_new"}
PARTS["concepts_new"] = "select * exclude (k) from after"
PARTS["rules_new"] = QUERIES["change_update_rules"].strip()
PARTS["trace_new"] = QUERIES["change_delete_trace"].replace("from fx_trace t", f"from ({QUERIES['change_update_trace'].strip()}) t")
_REBUILT = ("u_concepts", "u_rules", "u_trace", "concepts_all", "wide", "g")


def _on_changed(text: str) -> str:
    for old, new in {**_CHANGED, **{name: f"{name}_new" for name in _REBUILT}}.items():
        text = re.sub(rf"\b(from|join) {old}\b", rf"\1 {new}", text)
    return text


PARTS.update({f"{name}_new": _on_changed(PARTS[name]) for name in _REBUILT})
QUERIES["golden_incremental"] = _on_changed(QUALITY_REPORT)
QUERIES["golden_incremental_priority"] = _on_changed(QUERIES["golden_priority"])
_CELLS = [f"""coalesce('"' || replace(cast({c} as varchar), '"', '""') || '"', '')""" for c in RULE_NAMES if c != "ingestion_date"]
QUERIES["sheet_rejects"] = f"""
select 'reglas_calidad' as tabla, 'number of cells differs from the header' as motivo,
  case when id_regla_de_calidad like '%7' then {" || ',' || ".join(_CELLS[:-1])}
       else {" || ',' || ".join(_CELLS)} || ',extra' end as contenido, {RUN} as ingestion_date
from fx_rules where id_regla_de_calidad like '%7' or id_regla_de_calidad like '%31'"""
for _table, _plain in {
    "change_update_table": "change_update",
    "change_update_table_trace": "change_update_trace",
    "change_delete_table_rules": "change_delete_rules",
    "change_batch_table": "diff_applied",  # the snapshot after the same three batches
}.items():
    QUERIES[_table] = QUERIES[_plain]
QUERIES["job_golden_priority"] = QUERIES["golden_priority"]


def _needed(text: str, parts: dict[str, str]) -> list[str]:
    """Names of the parts the text uses, each after those it builds on."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in parts:
            if name not in ordered and re.search(rf"\b(from|join)\s+{name}\b", sql):
                visit(parts[name])
                if name not in ordered:
                    ordered.append(name)

    visit(text)
    return ordered


def oracle_sql() -> dict[str, str]:
    bodies = {**{view: text for view, (_, text) in VIEWS.items()}, **PARTS}
    statements = {}
    for key, query in QUERIES.items():
        named = [
            sql_view(name) if name in VIEWS else f"{name} as ({PARTS[name]})" for name in _needed(query, bodies)
        ]
        own = query.strip()
        if own.startswith("with "):
            named, own = [*named, own[5:]], None
        statements[key] = "with " + ",\n".join(named) + ("" if own is None else "\n" + own)
    return statements
