"""The driver's tables seen as dictionary tables.

One SQL text serves both engines. Each view reads the whole of one table:

====================  ==========  ==================================================
view                  table       role
====================  ==========  ==================================================
fx_concepts           part        concepts sheet, two parts share a term
fx_rules              customer    rules sheet, three customers share a term
fx_trace              lineitem    traceability sheet, many rows per code
fx_custom             supplier    concepts entered by hand
fx_updates            orders      edits of concepts, several per key, with a sequence
fx_inserts            customer    new concepts, some not acceptable
fx_rule_edits         orders      edits of rules, some with bad numbers
fx_versions           events      versions of a concept's priority over time
fx_sheet              lineitem    raw sheet cells with null tokens and blank rows
====================  ==========  ==================================================

They hold legend rows, blank keys, null groups, many spellings of yes, ``%`` and
bad numbers, blanks around keys and terms, and two key prefixes, on purpose.
Work grows with the tables: matches per key stay the same at every scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from termloom.schemas import CONCEPTS, RULES, TRACE

# Schemas of the tables read here: stated, so that no job has to infer them.
TABLES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

VIEWS = {
    "fx_concepts": (
        "part",
        """
select case when p_size % 25 = 0 then 'CRM-' || p_type
            when p_size % 10 = 3 then ' CRM' || lpad(cast(p_partkey as {STRING}), 9, '0') || ' '
            else 'CRM' || lpad(cast(p_partkey as {STRING}), 9, '0') end as codigo_de_entidad_del_dato,
  case when p_size % 19 = 0 then p_name || chr(10) || '"cita", fin' else p_name end as concepto_de_negocio,
  case when p_size % 17 = 0 then null
       when p_size % 13 = 0 then ' Termino ' || cast(cast(floor(p_partkey / 2) as bigint) as {STRING}) || ' '
       else 'Termino ' || cast(cast(floor(p_partkey / 2) as bigint) as {STRING}) end as termino_de_negocio,
  case when p_type = 'SMALL' then null else p_type end as nombre_del_dominio,
  case when p_size % 11 = 0 then null else p_brand end as nombre_del_subdominio,
  'Owner ' || p_brand as data_owner,
  case p_size % 5 when 0 then 'SI' when 1 then ' si ' when 2 then 'Si' when 3 then null else 'NO' end as dato_critico,
  case p_size % 3 when 0 then 'S' when 1 then '' else null end as personal,
  case p_size % 7 when 0 then 'Sí' when 1 then 'SÍ' else 'No' end as sensible,
  case when p_size % 6 = 0 then null else 'Def ' || p_name end as definicion_de_negocio,
  'Texto' as tipo_de_dato,
  case p_size % 4 when 0 then 'Alta' when 1 then 'Baja' else null end as prioridad_del_entidad_de_dato,
  cast('2024-01-' || lpad(cast(p_partkey % 28 + 1 as {STRING}), 2, '0') as {TS}) as ingestion_date
from {part}
union all select 'Identificador único secuencial, asignado al Entidad de Dato por Data Officer',
  'x','x','x','x','x','x','x','x','x','x','x', cast('2024-01-01' as {TS})
union all select '  ','x','x','x','x','x','x','x','x','x','x','x', cast('2024-01-01' as {TS})
union all select ' ','z','y','x','x','x','x','x','x','x','x','x', cast('2024-01-02' as {TS})
union all select null,'n1','x','x','x','x','x','x','x','x','x','x', cast('2024-01-02' as {TS})
union all select null,'n2','x','x','x','x','x','x','x','x','x','x', cast('2024-01-03' as {TS})
""",
    ),
    "fx_rules": (
        "customer",
        """
select case when c_nationkey = 7 then '  ' when c_nationkey = 8 then null
            else 'RC' || cast(c_custkey as {STRING}) end as id_regla_de_calidad,
  ' Termino ' || cast(cast(floor(c_custkey / 3) as bigint) as {STRING}) || ' ' as termino_de_negocio,
  'Regla ' || c_mktsegment as descripcion_de_regla_de_calidad,
  'Tipo ' || c_mktsegment as tipo_de_regla_de_calidad,
  case c_nationkey % 5 when 0 then 'Completitud' when 1 then 'Validez' when 2 then 'Precisión' else null end
    as principio_de_calidad_asociado,
  case when c_custkey % 7 = 0 then 'n/a'
       else cast(cast(c_acctbal as decimal(18,2)) as {STRING}) || '%' end as umbral_superior,
  case when c_custkey % 4 = 0 then null
       when c_custkey % 11 = 0 then '1.234,5'
       else replace(cast(cast(c_acctbal / 2 as decimal(18,1)) as {STRING}), '.', ',') end as umbral_inferior,
  cast('2024-02-' || lpad(cast(c_custkey % 28 + 1 as {STRING}), 2, '0') as {TS}) as ingestion_date
from {customer}
union all select 'Identificador de Regla de Calidad','x','x','x','x','x','x', cast('2024-02-01' as {TS})
""",
    ),
    "fx_trace": (
        "lineitem",
        """
select 'POL' || cast(l_partkey as {STRING}) as codigo_de_entidad_del_dato,
  'Entidad ' || cast(l_partkey as {STRING}) as nombre_de_entidad_del_dato,
  l_returnflag as tabla_en_fuente_oficial,
  case when l_partkey % 9 = 0 then null else l_linestatus end as campo_en_fuente_oficial,
  cast(l_suppkey % 5 as {STRING}) as aplicativos,
  cast(l_suppkey % 3 as {STRING}) as fuente_oficial,
  cast(l_linenumber as {STRING}) as esquema,
  case when l_partkey % 8 = 0 then '29/04/2026' else cast(cast(l_shipdate as date) as {STRING}) end
    as fecha_de_actualizacion_en_el_diccionario_tecnico,
  l_shipdate as ingestion_date
from {lineitem}
union all select 'Identificador único secuencial, asignado al Entidad de Dato por CDO',
  'x','x','x','x','x','x','x', cast('2024-03-01' as {TS})
""",
    ),
    "fx_custom": (
        "supplier",
        """
select s_name as concepto_de_negocio, 'Termino ' || cast(s_suppkey as {STRING}) as termino_de_negocio,
  case when s_nationkey = 3 then null else 'CUS' || lpad(cast(s_suppkey as {STRING}), 9, '0') end
    as codigo_de_entidad_del_dato,
  'Owner' as data_owner, 'SI' as dato_critico, 'NO' as personal, cast(null as {STRING}) as sensible,
  'Def' as definicion_de_negocio, 'Alta' as prioridad_del_entidad_de_dato
from {supplier}
""",
    ),
    "fx_updates": (
        "orders",
        """
select ' CRM' || lpad(cast(o_custkey as {STRING}), 9, '0') || '  ' as codigo_de_entidad_del_dato,
  'Concepto ' || cast(o_orderkey as {STRING}) as concepto_de_negocio,
  case when o_orderstatus = 'F' then '  ' else 'Nuevo ' || o_orderpriority end as termino_de_negocio,
  'Dominio ' || o_orderstatus as nombre_del_dominio, cast(null as {STRING}) as nombre_del_subdominio,
  ' Owner ' || o_orderstatus || ' ' as data_owner, 'Numero' as tipo_de_dato,
  o_orderpriority as prioridad_del_entidad_de_dato, 'NO' as dato_critico,
  'Def ' || o_orderstatus as definicion_de_negocio, o_orderkey as seq
from {orders}
""",
    ),
    "fx_inserts": (
        "customer",
        """
select case when c_nationkey = 4 then '' else ' NEW' || cast(c_custkey as {STRING}) end as codigo_de_entidad_del_dato,
  c_name as concepto_de_negocio,
  case when c_nationkey = 5 then null when c_nationkey = 6 then '  ' else 'Termino nuevo' end as termino_de_negocio,
  c_mktsegment as nombre_del_dominio, '' as nombre_del_subdominio, 'Owner' as data_owner,
  case when c_nationkey = 9 then 'Urgente' when c_nationkey = 10 then '' else 'Alta' end
    as prioridad_del_entidad_de_dato,
  case when c_nationkey = 11 then 'Sí' else 'SI' end as dato_critico,
  'se ignora' as logica_de_calculo
from {customer}
""",
    ),
    "fx_rule_edits": (
        "orders",
        """
select 'RC' || cast(o_custkey as {STRING}) as id_regla_de_calidad,
  'Termino ' || o_orderstatus as termino_de_negocio, 'Desc ' || o_orderpriority as descripcion_de_regla_de_calidad,
  'Tipo' as tipo_de_regla_de_calidad, '' as principio_de_calidad_asociado,
  case when o_orderkey % 5 = 0 then '95%' when o_orderkey % 5 = 1 then '' when o_orderkey % 5 = 2 then null
       else cast(cast(o_totalprice as decimal(18,2)) as {STRING}) end as umbral_superior,
  case when o_orderkey % 7 = 0 then '0,5' else '0.5' end as umbral_inferior,
  o_orderkey as seq
from {orders}
""",
    ),
    "fx_versions": (
        "events",
        """
select 'CRM' || lpad(cast(user_id as {STRING}), 9, '0') as codigo_de_entidad_del_dato,
  event_type as prioridad_del_entidad_de_dato, value as peso, event_id, ts as ingestion_date
from {events}
union all select case when event_id % 3 = 0 then null else 'CRM' || lpad(cast(user_id as {STRING}), 9, '0') end,
  'empate', value + 1, event_id, ts
from {events} where event_id % 20 < 3
""",
    ),
    "fx_sheet": (
        "lineitem",
        """
select case when l_tax = 0.0 then null when l_tax = 0.01 then 'nan' else 'POL' || cast(l_partkey as {STRING}) end
    as codigo_de_entidad_del_dato,
  case when l_tax = 0.0 then 'N/A' when l_tax = 0.02 then '#N/A' else 'SRC' || cast(l_suppkey as {STRING}) end
    as fuente_oficial,
  case when l_tax = 0.0 then '' when l_tax = 0.03 then 'NaT' else cast(cast(l_shipdate as date) as {STRING}) end
    as fecha_de_actualizacion_en_el_diccionario_tecnico,
  case when l_tax = 0.0 then 'null' when l_tax = 0.04 then ' nan ' else l_returnflag end as columna_desconocida
from {lineitem}
""",
    ),
}


def _all_columns(view: str, contract: StructType) -> None:
    """Fill the columns of a contract that a view does not map, from one that it does."""
    table, text = VIEWS[view]
    mapped = re.findall(r"\bas (\w+)\s*(?:,|\nfrom|$)", text.split("union all")[0])
    source = next(c for c in ("concepto_de_negocio", "tipo_de_regla_de_calidad", "nombre_de_entidad_del_dato") if c in mapped)
    more = ", ".join(
        f"case when length({source}) % {i % 5 + 2} = 0 then null else '{f.name[:4]} ' || substr({source}, {i % 7 + 1}, 5) end as {f.name}"
        for i, f in enumerate(contract.fields)
        if f.name not in mapped
    )
    VIEWS[view] = table, f"\nselect v.*, {more} from ({text}) v\n"


for _view, _contract in (("fx_concepts", CONCEPTS), ("fx_rules", RULES), ("fx_trace", TRACE)):
    _all_columns(_view, _contract)


def spark_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    table, text = VIEWS[view]
    filled = text.replace("{STRING}", "string").replace("{TS}", "timestamp_ntz")
    rows = spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(filled, **{table: rows})


def sql_view(view: str) -> str:
    """The view as a common table expression over the driver's own views."""
    table, text = VIEWS[view]
    filled = text.replace("{STRING}", "varchar").replace("{TS}", "timestamp").replace(f"{{{table}}}", table)
    return f"{view} as ({filled})"
