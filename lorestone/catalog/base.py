"""Registry of queries over the test tables, and text derived from them.

A query is a function (spark, folder) -> DataFrame with an optional SQL statement that gives the
same rows.  Derived inputs are plain SQL expressions that both engines evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


#: key columns of the tables that grow
KEYS = {
    "events": "event_id", "documents": "doc_id", "orders": "o_orderkey", "lineitem": "l_orderkey",
    "part": "p_partkey", "conversations": "conv_id", "embeddings": "vec_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, spread over the cores when its files make fewer scan tasks than there are cores.

    Large tables have many row groups and are read as they are.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in KEYS or _scan_tasks(df, cores) >= cores:
        return df
    return df.repartition(cores, KEYS[name])


def _scan_tasks(df: DataFrame, enough: int) -> int:
    """Upper bound of the scan tasks from the number and size of the files."""
    files = df.inputFiles()
    if len(files) >= enough:
        return len(files)
    total = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return len(files) + total // (128 << 20)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def derive_sql(source: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + f" from {source}"


def _pick(words: str, index: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', cast(1 + {index} % {n} as int))"


_WHO = _pick("Alice,Bruno,Carla,Dmitri,Elena,Farid,Greta,Hugo", "user_id")
_CITY = _pick("Oslo,Lima,Kyoto,Quito,Riga,Turin", "event_id")
_PROJECT = _pick("alder,birch,cedar,dogwood", "user_id")
_KIND = _pick("decision,failure,sprint,daemon,identity,moment,other", "event_id")
_DAY = "cast(cast(ts as date) as string)"
_N = "cast(regexp_extract(props, '[0-9]+', 0) as int)"

_SENTENCES = f"""case event_type
 when 'signup' then concat('Yesterday ', {_WHO}, ' moved to ', {_CITY}, ' on ', {_DAY}, ' and joined Team ', {_CITY}, '. We decided to adopt the Alder plan because the old one failed.')
 when 'purchase' then concat('In ', {_CITY}, ' the shop ', {_WHO}, ' Books sold ', {_N}, ' pages on ', {_DAY}, '. Invoice CHF ', {_N}, '.50 was paid. No refund was given to ', {_WHO}, '.')
 when 'error' then concat('The parser v1.', {_N} % 5, ' broke for ', {_WHO}, ' in ', {_CITY}, '. Accuracy was ', {_N}, '.5% on ', {_DAY}, ' because src/cache_file_reader.py failed. CacheReader needs PyTorch.')
 when 'view' then concat('On ', {_DAY}, ' ', {_WHO}, ' said "I like ', {_CITY}, ' Coffee". She visited ', {_CITY}, ' 3 days before ', {_DAY}, ' and never asked for a refund. I like tea, she added.')
 else concat('It was measured that ', {_WHO}, ' fixed v2.', {_N} % 7, ' with bm25. The result shows ', {_N}, '% more hits 2 weeks after ', {_DAY}, '. Actually, the first score was wrong, that is correct.')
 end"""

#: one dated note per event: name, one-line body and a Markdown text with blank-line paragraphs
MEMO = {
    "event_id": "event_id",
    "user_id": "user_id",
    "ts": "ts",
    "event_type": "event_type",
    "value": "value",
    "n": _N,
    "day": _DAY,
    "who": _WHO,
    "city": _CITY,
    "project": _PROJECT,
    "name": f"concat({_DAY}, '_', {_PROJECT}_, '_', {_KIND}, '-', event_id, '.md')".replace(
        f"{_PROJECT}_", _PROJECT
    ),
    "body": _SENTENCES,
    "text": f"concat('# Note ', event_id, chr(10), chr(10), {_SENTENCES}, chr(10), chr(10), "
            f"'- The plan for ', {_CITY}, ' is to reuse the gpu daemon with ', {_WHO}, '.', chr(10), "
            f"'- Contact ', lower({_WHO}), '.x@example.com or 555-010-', 1000 + {_N}, ' about it.', "
            f"case event_type when 'error' then concat(chr(10), '- The ', {_CITY}, ' bug broke the cache, a patch by ', {_WHO}, ' will resolve v1.', {_N} % 5, '.') "
            f"when 'click' then concat(chr(10), '- A better approach works for ', {_CITY}, ' with ', {_N}, ' shards.') else '' end)",
    "question": f"""case event_id % 8
 when 0 then concat('When did ', {_WHO}, ' move to ', {_CITY}, '?')
 when 1 then concat('How many pages did ', {_WHO}, ' Books sell in ', {_CITY}, '?')
 when 2 then concat('What version broke for ', {_WHO}, '?')
 when 3 then concat('Who likes ', {_CITY}, ' Coffee?')
 when 4 then concat('Did ', {_WHO}, ' ask for a refund?')
 when 5 then 'What accuracy score was measured?'
 when 6 then concat('How many days passed before ', {_WHO}, ' left?')
 else concat('Where is the current plan for ', {_CITY}, '?')
 end""",
}


def memo(spark: SparkSession, folder: str) -> DataFrame:
    return derive(table(spark, folder, "events"), MEMO)


MEMO_SQL = f"({derive_sql('events', MEMO)})"
