"""Read-only SQL over the tables of a folder: what is not known to be a plain query is refused."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from runweave.sources.fixtures import TABLES, table

#: Parsed plan nodes of plain queries.
NODES = set(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Union Intersect Except Subquery SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith "
    "UnresolvedInlineTable LocalRelation OneRowRelation Window WithWindowDefinition UnresolvedHaving Generate LateralJoin Pivot Unpivot Sample UnresolvedHint".split()
)
#: Functions of plain queries: none runs code, reads files or changes anything.
FUNCTIONS = set(
    "count sum avg mean min max min_by max_by first last any_value bool_and bool_or every some any stddev stddev_pop stddev_samp variance var_pop var_samp corr median percentile percentile_approx "
    "approx_count_distinct count_if collect_list collect_set array_agg listagg string_agg mode grouping grouping_id row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value first_value last_value "
    "abs ceil ceiling floor round bround sign sqrt power pow exp ln log log10 log2 mod pmod greatest least coalesce ifnull nullif nvl nvl2 if iff isnull isnotnull "
    "length char_length lower upper trim ltrim rtrim substr substring left right concat concat_ws replace repeat reverse split split_part instr locate position lpad rpad regexp_extract regexp_replace regexp_like startswith endswith contains "
    "year quarter month day dayofmonth dayofweek dayofyear hour minute second date trunc date_trunc date_add date_sub datediff add_months last_day to_date to_timestamp date_format extract date_part unix_timestamp current_date current_timestamp "
    "array map struct named_struct size cardinality element_at array_contains array_distinct array_sort sort_array slice sequence explode posexplode map_keys map_values get_json_object json_tuple from_json to_json "
    "md5 sha1 sha2 crc32 hash xxhash64 hex cast try_cast like and or not in".split()
)


class ReadOnlyError(ValueError):
    """The statement is not a plain query."""


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def checked(spark: SparkSession, text: str) -> set[str]:
    """The tables that one query reads. Its parsed plan is inspected, before anything is analysed: plan
    nodes and functions have to be known, and relations to be tables or the query's own."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    own, read = set(), set()
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if kind not in NODES:
            raise ReadOnlyError(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1:
                raise ReadOnlyError(f"{'.'.join(parts)} is not a table")
            read.add(parts[0].lower())
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                own.add(pair.productElement(0).lower())
                todo.append(pair.productElement(1))
        if kind == "Generate":
            _check(node.generator(), todo)
        todo += _items(node.children())
        for e in _items(node.expressions()):
            _check(e, todo)
    strange = read - own - set(TABLES)
    if strange:
        raise ReadOnlyError(f"{', '.join(sorted(strange))}: no such table")
    return read & set(TABLES)


def _check(expression, plans: list) -> None:
    """Refuse unknown functions; plans of subqueries go to ``plans``."""
    todo = [expression]
    while todo:
        e = todo.pop()
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            name = ".".join(_items(e.nameParts())).lower()
            if name not in FUNCTIONS:
                raise ReadOnlyError(f"the function {name} is not allowed")
        elif kind in ("UnresolvedGenerator", "UnresolvedTableValuedFunction", "CallMethodViaReflection"):
            name = ".".join(_items(e.name().nameParts())) if kind == "UnresolvedGenerator" and hasattr(e.name(), "nameParts") else kind
            raise ReadOnlyError(f"{name} is not allowed") if name not in FUNCTIONS else None
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
            plans.append(e.query().plan() if kind == "InSubquery" else e.plan())
        todo += _items(e.children())


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one plain query over tables of ``sf_dir``. They are views only while it is analysed; a temporary
    view that has a table's name before is lost."""
    used = checked(spark, text)
    try:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)
    finally:
        for t in used:
            spark.catalog.dropTempView(t)
