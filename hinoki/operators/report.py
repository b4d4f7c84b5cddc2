"""Tables of a report: counts by two columns, with totals, as lines of Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(rows: DataFrame, by: str, across: str, columns: list[str]) -> DataFrame:
    """(nth, line): a header, a rule, a line a value of by in order, and the totals.  The columns
    are fixed, so no pass over the data looks for them; the last one counts all rows."""
    count = lambda c: F.count_if(F.col(across) == c).cast("bigint").alias(f"c{columns.index(c)}")
    rolled = rows.where(F.col(by).isNotNull()).rollup(by).agg(*(count(c) for c in columns), F.count("*").alias("total"), F.grouping_id().alias("g"))
    cells = F.concat_ws(" | ", F.when(F.col("g") == 1, "all").otherwise(F.col(by)), *(F.col(f"c{i}").cast("string") for i in range(len(columns))), F.col("total").cast("string"))
    lines = rolled.select(F.col("g").cast("int").alias("part"), F.coalesce(F.col(by), F.lit("")).alias("at"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(-2, "", head_of(by, columns)), (-1, "", rule_of(columns))], "part int, at string, line string")
    return head.unionByName(lines)


def head_of(by: str, columns: list[str]) -> str:
    return "| " + " | ".join([by, *columns, "all"]) + " |"


def rule_of(columns: list[str]) -> str:
    return "|" + " - |" * (len(columns) + 2)


def pivot_sql(rows: str, by: str, across: str, columns: list[str]) -> str:
    """The same for another engine, by one count a cell; ends a list of CTEs."""
    cells = " || ' | ' || ".join(f"(select count(*) from {rows} as y where y.{across} = '{c}' and (x.v is null or y.{by} = x.v))::varchar" for c in columns)
    total = f"(select count(*) from {rows} as y where x.v is null or y.{by} = x.v)::varchar"
    return (
        f"vs as (select distinct {by} as v from {rows} as r where {by} is not null union all select null) "
        f"select (case when v is null then 1 else 0 end)::int as part, coalesce(v, '') as at, '| ' || coalesce(v, 'all') || ' | ' || {cells} || ' | ' || {total} || ' |' as line from vs as x "
        f"union all select -2, '', '{head_of(by, columns)}' union all select -1, '', '{rule_of(columns)}'"
    )
