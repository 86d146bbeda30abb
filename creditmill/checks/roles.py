"""The credit tables as views over the test tables.

The credit data itself is not at hand, so every table is a deterministic projection of a test table.
The expressions are plain SQL that Spark and the checking engine read alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.contract import schema as S
from creditmill.contract import vocabulary as V
from creditmill.plans.families import CLIENT_BALANCE
from creditmill.session import new_table_path
from creditmill.sources.tables import LARGE_KEY_ROWS, buckets_by, save_bucketed

FIRST_ID = 100000
CLIENT = f"({FIRST_ID} + c_custkey)"
ORDER_CLIENT = f"({FIRST_ID} + o_custkey)"


def _pick(values: Sequence[str], number: str, holes: int = 0) -> str:
    """One of ``values`` by ``number``; the last ``holes`` residues are missing."""
    size = len(values) + holes
    return f"nullif(split_part('{'|'.join(values)}', '|', CAST(1 + ({number}) % {size} AS INT)), '')"


def _fraction(number: str, parts: int) -> str:
    return f"(({number}) % {parts}) / CAST({parts} AS DOUBLE)"


def _some(condition: str, value: str) -> str:
    """``value`` where the condition holds, else missing."""
    return f"CASE WHEN {condition} THEN {value} END"


def _application() -> list[tuple[str, str]]:
    given = {
        S.KEY: CLIENT,
        S.LABEL: "CASE WHEN c_acctbal < 0 OR c_custkey % 10 = 0 THEN 1 ELSE 0 END",
        "CODE_GENDER": "CASE WHEN c_custkey % 97 = 0 THEN 'XNA' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
        "FLAG_OWN_CAR": _pick(["N", "Y"], "c_custkey / 2 - 0.5 * (c_custkey % 2)"),
        "FLAG_OWN_REALTY": _pick(["N", "Y"], "c_nationkey"),
        "CNT_CHILDREN": "CASE WHEN c_custkey % 31 = 0 THEN 21 ELSE c_custkey % 5 END",
        "AMT_INCOME_TOTAL": _some("c_acctbal > 0", "c_acctbal"),
        "AMT_CREDIT": "10000 + c_custkey % 5000",
        "AMT_ANNUITY": _some("c_custkey % 11 <> 0", "500 + c_custkey % 700"),
        "AMT_GOODS_PRICE": _some("c_custkey % 19 <> 0", "9000 + c_custkey % 5000"),
        "REGION_POPULATION_RELATIVE": _fraction("c_custkey * 7", 100),
        "DAYS_BIRTH": "-(6570 + (c_custkey * 13) % 18980)",
        "DAYS_EMPLOYED": "CASE WHEN c_custkey % 7 = 0 THEN 365243 ELSE -(c_custkey % 9000) END",
        "DAYS_REGISTRATION": "-((c_custkey * 3) % 24000)",
        "DAYS_ID_PUBLISH": "-((c_custkey * 5) % 9000)",
        "OWN_CAR_AGE": _some("c_custkey % 3 = 0", "c_custkey % 40"),
        "FLAG_PHONE": "CASE WHEN c_custkey % 50 = 3 THEN 2 ELSE c_custkey % 2 END",
        "OCCUPATION_TYPE": "CASE WHEN c_custkey % 41 = 0 THEN 'Astronaut' ELSE "
                           + _pick(V.APPLICATION["OCCUPATION_TYPE"], "c_custkey", 4) + " END",
        "CNT_FAM_MEMBERS": "c_custkey % 8",
        "REGION_RATING_CLIENT": "1 + c_custkey % 3",
        "REGION_RATING_CLIENT_W_CITY": "1 + (c_custkey * 5 + 1) % 3",
        "HOUR_APPR_PROCESS_START": "c_custkey % 24",
        "DAYS_LAST_PHONE_CHANGE": "-(c_custkey % 4000)",
    }
    out = []
    for i, field in enumerate(S.APPLICATION.fields):
        name, kind = field.name, field.dataType.typeName()
        if name in given:
            sql = given[name]
        elif name in V.APPLICATION:
            holes = 1 if name in S.OPTIONAL else 0
            sql = _pick(V.APPLICATION[name], f"c_custkey * {1 + i % 3}", holes)
        elif name in S.FLAGS:
            sql = f"CASE WHEN (c_custkey + {i}) % 9 = 0 THEN 1 ELSE 0 END"
        elif name in S.SOCIAL_CIRCLE or name in S.BUREAU_REQUESTS:
            sql = _some(f"c_custkey % {6 + i % 5} <> 0", f"(c_custkey + {i}) % 12")
        else:
            sql = _some(f"(c_custkey + {i}) % {3 + i % 4} <> 0", _fraction(f"c_custkey * {i + 7}", 1000))
        cast = {"long": "BIGINT", "double": "DOUBLE", "string": "STRING"}[kind]
        out.append((name, f"CAST({sql} AS {cast})"))
    return out


def _cast(columns: dict[str, str], table) -> list[tuple[str, str]]:
    kinds = {f.name: {"long": "BIGINT", "double": "DOUBLE", "string": "STRING"}[f.dataType.typeName()]
             for f in table.fields}
    return [(name, f"CAST({columns[name]} AS {kinds[name]})") for name in kinds if name in columns]


_BUREAU = _cast({
    S.KEY: ORDER_CLIENT,
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_ACTIVE": "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE "
                     + _pick(["Bad debt", "Sold"], "o_orderkey", 1) + " END",
    "CREDIT_CURRENCY": _pick(V.BUREAU["CREDIT_CURRENCY"], "o_orderkey", 1),
    "CREDIT_TYPE": _pick(V.BUREAU["CREDIT_TYPE"], "o_orderkey", 2),
    "DAYS_CREDIT": "-(o_orderkey % 2900)",
    "CREDIT_DAY_OVERDUE": "CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey % 300 ELSE 0 END",
    "DAYS_CREDIT_ENDDATE": _some("o_orderkey % 6 <> 0", "(o_orderkey % 4000) - 2000"),
    "AMT_CREDIT_MAX_OVERDUE": _some("o_orderkey % 3 = 0", "o_totalprice / 16"),
    "CNT_CREDIT_PROLONG": "CASE WHEN o_orderkey % 30 = 0 THEN 1 ELSE 0 END",
    "AMT_CREDIT_SUM": "o_totalprice",
    "AMT_CREDIT_SUM_DEBT": _some("o_orderstatus <> 'F'", "o_totalprice / 2"),
    "AMT_CREDIT_SUM_LIMIT": _some("o_orderkey % 4 = 0", "o_totalprice / 4"),
    "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderkey % 25 = 0 THEN o_totalprice / 8 ELSE 0 END",
    "DAYS_CREDIT_UPDATE": "-(o_orderkey % 700)",
    "AMT_ANNUITY": _some("o_orderkey % 5 <> 0", "o_totalprice / 32"),
}, S.BUREAU)

_BALANCE = _cast({
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": "-l_linenumber",
    "STATUS": "CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN 'X' ELSE "
              + _pick(V.BUREAU_BALANCE["STATUS"][:6], "l_partkey", 1) + " END",
}, S.BUREAU_BALANCE)

_PREVIOUS = _cast({
    "SK_ID_PREV": "o_orderkey",
    S.KEY: ORDER_CLIENT,
    "AMT_ANNUITY": _some("o_orderkey % 4 <> 0", "o_totalprice / 64"),
    "AMT_APPLICATION": "CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_totalprice / 2 END",
    "AMT_CREDIT": "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END",
    "AMT_DOWN_PAYMENT": _some("o_orderkey % 2 = 0", "o_totalprice / 8"),
    "AMT_GOODS_PRICE": _some("o_orderkey % 5 <> 0", "o_totalprice * 2"),
    "HOUR_APPR_PROCESS_START": "o_orderkey % 24",
    "RATE_DOWN_PAYMENT": _some("o_orderkey % 2 = 0", _fraction("o_orderkey", 64)),
    "DAYS_DECISION": "-(1 + o_orderkey % 2900)",
    "CNT_PAYMENT": _some("o_orderkey % 3 <> 0", "6 * (1 + o_orderkey % 10)"),
    **{name: f"CASE WHEN o_orderkey % {5 + i} = 0 THEN 365243 ELSE -(o_orderkey % 2800) END"
       for i, name in enumerate(["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                                 "DAYS_LAST_DUE", "DAYS_TERMINATION"])},
    **{name: _pick(values, f"o_orderkey * {i + 1}", i % 3)
       for i, (name, values) in enumerate(V.PREVIOUS.items())},
    "NAME_CONTRACT_STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE "
                            + _pick(["Canceled", "Unused offer"], "o_orderkey", 1) + " END",
}, S.PREVIOUS)

_POS = _cast({
    "SK_ID_PREV": "l_orderkey",
    S.KEY: ORDER_CLIENT,
    "MONTHS_BALANCE": "-l_linenumber",
    "SK_DPD": "l_suppkey % 5",
    "SK_DPD_DEF": "l_suppkey % 3",
    "NAME_CONTRACT_STATUS": "CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'R' THEN "
                            + _pick(V.POS_CASH["NAME_CONTRACT_STATUS"], "l_partkey") + " END",
}, S.POS_CASH)

_DUE = "-(l_partkey % 1000)"
_INSTALLMENTS = _cast({
    "SK_ID_PREV": "l_orderkey",
    S.KEY: ORDER_CLIENT,
    "NUM_INSTALMENT_VERSION": "l_linenumber",
    "DAYS_INSTALMENT": _DUE,
    "DAYS_ENTRY_PAYMENT": f"CASE WHEN l_tax = 0 THEN NULL ELSE {_DUE} + l_suppkey % 21 - 10 END",
    "AMT_INSTALMENT": "CASE WHEN l_linenumber = 7 AND l_partkey % 20 = 0 THEN 0 ELSE l_extendedprice END",
    "AMT_PAYMENT": "l_extendedprice * (1 - l_discount)",
}, S.INSTALLMENTS)

_CARD = _cast({
    "SK_ID_PREV": "l_orderkey",
    S.KEY: ORDER_CLIENT,
    **{name: [f"l_quantity * {i + 1}", f"l_extendedprice / {1 << (i % 6)}", "l_discount * 64",
              f"nullif(l_tax, 0) * {i + 1}", f"l_suppkey % {i + 3}"][i % 5]
       for i, name in enumerate(S.CREDIT_CARD_NUMBERS)},
    "MONTHS_BALANCE": "-l_linenumber",
    "NAME_CONTRACT_STATUS": "CASE l_linestatus WHEN 'F' THEN 'Completed' ELSE "
                            + _pick(V.CREDIT_CARD["NAME_CONTRACT_STATUS"], "l_partkey", 1) + " END",
}, S.CREDIT_CARD)

THRESHOLD = "CAST(0.33 AS DOUBLE)"
_FAILED = "event_type = 'error'"
_PROBABILITY = _some("event_type <> 'error'", "least(value / 200, CAST(1 AS DOUBLE))")
_LATENCY = "CAST(floor(value) AS INT)"
_ASSEMBLY = _some("event_type <> 'error' AND event_id % 11 <> 0", "CAST(floor(value / 2) AS INT)")
_INFERENCE = _some("event_type <> 'error' AND event_id % 11 <> 0", "CAST(floor(value / 4) AS INT)")
_K = "regexp_extract(props, '([0-9]+)', 1)"

_LOG = [
    ("id", "concat('log-', CAST(event_id AS STRING))"),
    ("timestamp", "ts"),
    ("sk_id_curr", f"CAST({FIRST_ID} + user_id AS BIGINT)"),
    ("client_known", "user_id % 10 <> 0"),
    ("latency_ms", _LATENCY),
    ("feature_assembly_ms", _ASSEMBLY),
    ("inference_ms", _INFERENCE),
    ("inference_cpu_ms", _some("event_type <> 'error' AND event_id % 7 <> 0", "CAST(floor(value / 5) AS INT)")),
    ("plumbing_ms", f"CASE WHEN event_type <> 'error' AND event_id % 11 <> 0 THEN "
                    f"greatest(0, {_LATENCY} - CAST(floor(value / 2) AS INT) - CAST(floor(value / 4) AS INT)) END"),
    ("db_log_ms", _some("event_id % 13 <> 0", "CAST(300 + event_id % 100 AS INT)")),
    ("status_code", f"CASE WHEN {_FAILED} THEN 500 ELSE 200 END"),
    ("error_message", _some(_FAILED, "'ValueError: bad input'")),
    ("raw_input", "props"),
    ("features", f"CASE WHEN {_FAILED} THEN '{{}}' ELSE concat("
                 f"'{{\"EXT_SOURCE_1\": 0.', lpad({_K}, 2, '0'), "
                 "', \"AMT_CREDIT\": ', CAST(10000 + event_id % 5000 AS STRING), "
                 "', \"AMT_INCOME_TOTAL\": ', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), "
                 "', \"DAYS_EMPLOYED\": null, \"CODE_GENDER\": ', CAST(user_id % 2 AS STRING), '}') END"),
    ("probability_default", _PROBABILITY),
    ("decision", f"CASE WHEN {_FAILED} THEN 'ERROR' WHEN least(value / 200, CAST(1 AS DOUBLE)) >= {THRESHOLD} "
                 "THEN 'REFUSED' ELSE 'GRANTED' END"),
    ("threshold", THRESHOLD),
    ("model_version", "CASE WHEN event_id % 3 = 0 THEN '1' ELSE '2' END"),
    ("top_shap", "CAST(NULL AS STRING)"),
    ("ground_truth", "CAST(NULL AS INT)"),
]

# requests come from all applicants; every tenth asks under an id that no table knows
_REQUEST = [(name, f"CASE WHEN c_custkey % 10 = 0 THEN 900000000 + c_custkey ELSE {sql} END"
             if name == S.KEY else sql) for name, sql in _application() if name != S.LABEL]

_ITEMS = "lineitem JOIN orders ON l_orderkey = o_orderkey"

# role -> (relation, columns)
ROLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "application": ("customer", _application()),
    "request": ("customer", _REQUEST),
    "bureau": ("orders", _BUREAU),
    "bureau_balance": ("lineitem", _BALANCE),
    "previous_application": ("orders", _PREVIOUS),
    "POS_CASH_balance": (_ITEMS, _POS),
    "installments_payments": (_ITEMS, _INSTALLMENTS),
    "credit_card_balance": (_ITEMS, _CARD),
    "prediction_log": ("events", _LOG),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name != _ITEMS:
        return table(spark, sf_dir, name)
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ROLES[name]
    return relation(spark, sf_dir, source).selectExpr(*[f"{sql} AS `{column}`" for column, sql in columns])


def placed_role(spark: SparkSession, sf_dir: str, name: str, buckets: int) -> DataFrame:
    """``role`` with its rows placed by client as a table in ``buckets`` is, so that a join with it moves neither.

    The few columns of the test relation move, before the many of the role are spread out. Rows of a client that is too
    large for a bucket, or very many rows without a client, stay where they are: the plain view.
    """
    source, columns = ROLES[name]
    keyed = relation(spark, sf_dir, source).selectExpr("*", f"{dict(columns)[S.KEY]} AS {S.KEY}")
    _, even = buckets_by(keyed, S.KEY)
    if not even or keyed.where(F.col(S.KEY).isNull()).count() > LARGE_KEY_ROWS:
        return role(spark, sf_dir, name)
    return keyed.repartition(buckets, S.KEY).selectExpr(
        *[f"{S.KEY if column == S.KEY else sql} AS `{column}`" for column, sql in columns])


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` as a table in buckets by client."""
    path = new_table_path(df.sparkSession, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    save_bucketed(df, table_name, buckets, path=path)
    return df.sparkSession.table(table_name)


@dataclass(frozen=True)
class Children:
    """The child tables, the number of buckets for tables of their clients, and whether the families may use them."""

    tables: dict[str, DataFrame]
    buckets: int
    even: bool

    @property
    def family_buckets(self) -> int | None:
        return self.buckets if self.even else None


#: test relation -> (the client in it, the columns that the roles over it read)
_BASE = {
    "orders": (ORDER_CLIENT, ["o_orderkey", "o_orderstatus", "o_totalprice"]),
    _ITEMS: (ORDER_CLIENT, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                            "l_discount", "l_tax", "l_returnflag", "l_linestatus"]),
}
_BY_CLIENT = ["previous_application", "POS_CASH_balance", "installments_payments", "credit_card_balance"]


def child_tables(spark: SparkSession, sf_dir: str) -> Children:
    """The six child tables. Those with a client are views over two tables in buckets by client: order lines meet their
    orders once, and move once by client, before their columns are spread out.

    The balances are order lines too. If no client has two credits of one id, a seventh table has those of known credits
    with their client, from the same buckets, and the credits lie there as well; else a line that met both would count twice.
    With a client that is too large for a bucket all are plain views, whose families split and merge its rows.
    """
    base = {name: relation(spark, sf_dir, name).selectExpr(f"CAST({client} AS BIGINT) AS {S.KEY}", *columns)
            .where(F.col(S.KEY).isNotNull()) for name, (client, columns) in _BASE.items()}
    found = [buckets_by(df, S.KEY) for df in base.values()]
    buckets, even = max(n for n, _ in found), all(ok for _, ok in found)
    tables = {name: role(spark, sf_dir, name) for name in ["bureau", "bureau_balance", *([] if even else _BY_CLIENT)]}
    if even:
        kept = {name: bucketed(df, f"by-client-{i}", buckets) for i, (name, df) in enumerate(base.items())}
        for name in _BY_CLIENT:
            tables[name] = _view(kept, name)
        if _credits_differ(kept["orders"]):
            tables["bureau"] = _view(kept, "bureau")
            tables[CLIENT_BALANCE] = _view({"lineitem": kept[_ITEMS]}, "bureau_balance", S.KEY)
    return Children(tables, buckets, even)


def _view(kept: dict[str, DataFrame], name: str, *carried: str) -> DataFrame:
    """The role ``name`` over a kept table that has the client already, after the ``carried`` columns."""
    source, columns = ROLES[name]
    return kept[source].selectExpr(
        *carried, *[f"{S.KEY if column == S.KEY else sql} AS `{column}`" for column, sql in columns])


def _credits_differ(orders: DataFrame) -> bool:
    """Whether no client has two orders of one id; counted where the rows lie."""
    ids = orders.where(F.col("o_orderkey").isNotNull()).groupBy(S.KEY, "o_orderkey")
    return ids.agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def role_sql(name: str) -> str:
    relation, columns = ROLES[name]
    listed = ",\n  ".join(f'{sql} AS "{column}"' for column, sql in columns)
    return f"SELECT\n  {listed}\nFROM {relation}"


def with_roles(sql: str, *names: str, **ctes: str) -> str:
    """Prefix ``sql`` with the named roles and further named subqueries."""
    parts = [f"{name} AS ({role_sql(name)})" for name in names]
    parts += [f"{name} AS ({body})" for name, body in ctes.items()]
    return f"WITH {', '.join(parts)} {sql}"
