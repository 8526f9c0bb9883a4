"""The registered queries of the library's own operators, with DuckDB SQL for each.

``SHARED`` is SQL that both engines run as it is; ``QUERIES`` are built with the library's
operators, and ``ORACLE_SQL`` says the same in DuckDB's SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..operators import changes, checks, joins, schema
from ..operators.incremental import Slice, capture, read_slice, trim
from ..sources import ranges
from ..sources.contracts import project, project_json
from ..sources.files import hive_parts, read_files, write_by_calendar, write_files
from ..storage import new_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(dialect.check_sql(sql))


SHARED: dict[str, str] = {
    # projections, filters, predicates
    "projection_alias": "select o_orderkey as id, o_totalprice * 2 as doubled, upper(o_orderstatus) as status from orders",
    "filter_conjunction": "select l_orderkey, l_linenumber from lineitem where l_quantity > 30 and l_discount >= 0.05 and l_returnflag = 'R'",
    "filter_disjunction": "select l_orderkey, l_linenumber from lineitem where l_quantity > 45 or (l_discount = 0 and l_tax = 0)",
    "filter_null_tests": "select count(*) as n, sum(case when o.o_orderkey is null then 1 else 0 end)::bigint as no_orders from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P' where c.c_name is not null",
    "in_list": "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)",
    "in_subquery": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)",
    "not_in_subquery": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "exists_subquery": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 100000)",
    "not_exists_subquery": "select p_partkey from part p where not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_quantity > 40)",
    "case_coalesce": "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, coalesce(nullif(o_orderstatus, 'F'), 'done') as state, greatest(o_totalprice, 1000.0) as at_least, least(o_totalprice, 1000.0) as at_most from orders",
    "star_except": "select * except (o_totalprice, o_orderdate) from orders",
    "casts": "select o_orderkey, o_orderkey::varchar(20) as as_text, cast(o_totalprice as decimal(18,2)) as price, o_orderdate::date as day from orders",
    "common_table": "with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey), top as (select * from big where total > 300000) select c_name, round(total, 2) as total from top join customer on c_custkey = o_custkey",
    "recursive_table": "with recursive steps(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from steps where n < 15) select n, f from steps",
    "derived_table": "select band, count(*) as n from (select o_orderkey % 10 as band from orders) t group by band",
    "scalar_subquery": "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)",
    "correlated_subquery": "select l_orderkey, l_linenumber from lineitem l where l_quantity > (select avg(l2.l_quantity) * 1.5 from lineitem l2 where l2.l_partkey = l.l_partkey)",
    # joins
    "join_inner": "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "join_left": "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' group by c_custkey",
    "join_right": "select c.c_custkey, o.o_orderkey from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 250000",
    "join_full": "select coalesce(a.k, b.k) as k, a.n as n_a, b.n as n_b from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 5000 group by c_nationkey) a full join (select s_nationkey as k, count(*) as n from supplier group by s_nationkey) b on a.k = b.k",
    "join_semi": "select c_custkey from customer semi join orders on c_custkey = o_custkey",
    "join_anti": "select c_custkey from customer anti join orders on c_custkey = o_custkey",
    "join_cross": "select a.r_name as a, b.n_name as b from region a cross join nation b",
    "join_using": "select k, x, y from (select c_nationkey as k, count(*) as x from customer group by c_nationkey) a join (select s_nationkey as k, count(*) as y from supplier group by s_nationkey) b using (k)",
    "join_natural": "select n_regionkey, r_name, n from (select n_regionkey, count(*) as n from nation group by n_regionkey) a natural join (select r_regionkey as n_regionkey, r_name from region) b",
    "join_self": "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_theta": "select s.s_suppkey, count(*) as n from supplier s join nation n on s.s_nationkey > n.n_nationkey group by s.s_suppkey",
    # aggregates
    "group_by": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice), 4) as price, min(l_discount) as low, max(l_tax) as high from lineitem group by l_returnflag, l_linestatus",
    "having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15",
    "filtered_aggregate": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as done, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0), 2) as still_open from orders group by o_orderpriority",
    "bool_aggregate": "select o_custkey, bool_or(o_orderstatus = 'P') as some_pending, bool_and(o_totalprice > 1000) as all_large from orders group by o_custkey",
    "distinct_rows": "select distinct c_mktsegment, c_nationkey from customer",
    "count_distinct": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "rollup": "select c_nationkey, c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by rollup (c_nationkey, c_mktsegment)",
    "group_by_all": "select c_mktsegment, c_nationkey % 5 as band, count(*) as n from customer group by all",
    "min_max_by": "select o_custkey, max_by(o_orderkey, o_totalprice) as dearest, min_by(o_orderkey, o_totalprice) as cheapest from orders group by o_custkey",
    "statistics": "select l_returnflag, round(stddev_samp(l_quantity), 4) as spread, round(var_pop(l_discount), 6) as var, round(corr(l_quantity, l_extendedprice), 4) as c from lineitem group by l_returnflag",
    # windows
    "window_row_number": "select o_orderkey, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::bigint as k from orders",
    "window_ranks": "select c_custkey, (rank() over (partition by c_nationkey order by c_acctbal))::bigint as r, (dense_rank() over (partition by c_nationkey order by c_mktsegment))::bigint as d, (ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey))::bigint as q from customer",
    "window_offsets": "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, lead(o_totalprice, 2, 0.0) over (partition by o_custkey order by o_orderdate, o_orderkey) as later from orders",
    "window_values": "select o_orderkey, first_value(o_orderkey) over w as first_key, last_value(o_orderkey) over w as last_key, nth_value(o_orderkey, 2) over w as second_key from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)",
    "window_distribution": "select c_custkey, round(cume_dist() over (partition by c_nationkey order by c_acctbal), 6) as c, round(percent_rank() over (partition by c_nationkey order by c_acctbal), 6) as p from customer",
    "window_rows_frame": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as recent from orders",
    "window_range_frame": "select event_id, count(*) over (partition by user_id order by event_id range between 500 preceding and current row) as near from events",
    # sets
    "union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "union_all": "select c_nationkey as k, 'c' as kind from customer union all select s_nationkey, 's' from supplier",
    "intersect_rows": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "except_rows": "select c_custkey as k from customer except select o_custkey from orders",
    "intersect_all": "select c_nationkey as k from customer intersect all select s_nationkey from supplier",
    "except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    # order and limit
    "order_nulls_last": "select o_orderkey from (select o_orderkey, nullif(o_orderstatus, 'F') as s from orders) t order by s nulls last, o_orderkey",
    "top_k": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20",
    "offset_page": "select p_partkey, p_name from part order by p_partkey limit 25 offset 50",
    # scalars
    "date_parts": "select o_orderkey, date_trunc('month', o_orderdate)::date as month, extract(year from o_orderdate)::bigint as y, day(o_orderdate)::bigint as d from orders",
    "interval_arithmetic": "select event_id, ts - interval 2 hour as earlier, ts + interval 1 day as later from events",
    "text_functions": "select p_partkey, length(p_name)::bigint as n, lower(p_name) as low, concat_ws('-', p_brand, p_type) as joined, substring(p_name, 2, 3) as part, replace(p_type, ' ', '_') as kind, trim(p_name) as trimmed from part",
    "math_functions": "select l_orderkey, l_linenumber, abs(l_discount - 0.05) as off, floor(l_extendedprice)::bigint as whole, ceil(l_quantity / 7)::bigint as packs, round(sqrt(l_extendedprice), 6) as root, (l_orderkey % 7)::bigint as rest, round(ln(l_quantity + 1), 6) as lg from lineitem",
    # queries over several tables, as reports have them
    "report_pricing": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "report_shipping": "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderpriority from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey, o_orderpriority order by revenue desc, l_orderkey limit 10",
    "report_local_suppliers": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name",
    "report_forecast": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "report_large_orders": "select c_name, o_orderkey, round(sum(l_quantity), 2) as qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 180) group by c_name, o_orderkey",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, sql=sql: run_sql(spark, sf_dir, sql)) for name, sql in SHARED.items()}
ORACLE_SQL: dict[str, str] = dict(SHARED)


def query(sql: str | None):
    """Register the function under its name, with the DuckDB SQL that it must equal."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- joins that Spark SQL lacks ---------------------------------------------------------------


@query("""select e.event_id, e.user_id, o.o_orderkey, o.o_totalprice from events e asof left join
(select o_custkey as user_id, o_orderdate as at, max(o_orderkey) as o_orderkey, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by all) o on e.user_id = o.user_id and e.ts >= o.at""")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), "o_orderkey", "o_totalprice")
    return joins.asof_join(e, o, ("ts", "at"), ["user_id"], width=90 * 86_400).select("event_id", "user_id", "o_orderkey", "o_totalprice")


@query("""select e.event_id, o.o_orderkey from (select event_id, ts, case when event_id % 3 > 0 then user_id end as k from events) e
asof left join (select o_orderkey, o_orderdate, case when o_orderkey % 5 > 0 then o_custkey end as k from orders) o on e.k = o.k and e.ts >= o.o_orderdate""")
def join_asof_null_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.expr("case when event_id % 3 > 0 then user_id end").alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), F.expr("case when o_orderkey % 5 > 0 then o_custkey end").alias("k"))
    return joins.asof_join(e, o, ("ts", "at"), ["k"]).select("event_id", "o_orderkey")


@query("""select a.n_name, b.s_name from (select n_name, row_number() over (order by n_nationkey) as k from nation) a
full join (select s_name, row_number() over (order by s_suppkey desc) as k from supplier) b on a.k = b.k""")
def join_positional(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").withColumn("back", -F.col("s_suppkey"))
    return joins.positional_join(nation, supplier, ["n_nationkey"], ["back"]).select("n_name", "s_name")


@query("""select p.p_partkey, count(*) as n from part p join (select c_custkey, c_acctbal as low, c_acctbal + 20 as high from customer) c
on p.p_retailprice >= c.low and p.p_retailprice < c.high group by p.p_partkey""")
def join_interval(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + 20).alias("high"))
    counted = joins.interval_counts(p, c, "p_retailprice", "low", "high", "n").where("n > 0")
    return counted.groupBy("p_partkey").agg(F.sum("n").alias("n"))


@query("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
def distinct_on_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.distinct_on(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def qualify_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return changes.last_by(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select s_suppkey as k, s_name as name, null::double as balance from supplier union all by name select c_custkey as k, c_acctbal as balance, null::varchar as name from customer")
def union_by_name(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("k")), allowMissingColumns=True)


@query("select o_orderstatus, count(*) filter (o_orderpriority = '1-URGENT') as urgent, count(*) filter (o_orderpriority = '5-LOW') as low from orders group by o_orderstatus")
def pivot_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_orderkey"))
    return o.select("o_orderstatus", F.coalesce("`1-URGENT`", F.lit(0)).cast("long").alias("urgent"), F.coalesce("`5-LOW`", F.lit(0)).cast("long").alias("low"))


@query("select n_regionkey, string_agg(n_name, '|' order by n_name desc) as names from nation group by n_regionkey")
def string_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name"), asc=False), "|").alias("names"))


@query("select l_returnflag, quantile_cont(l_quantity, 0.5) as mid, quantile_cont(l_extendedprice, 0.9) as high from lineitem group by l_returnflag")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(dialect.median(F.col("l_quantity")).alias("mid"), F.percentile("l_extendedprice", 0.9).alias("high"))


@query("select l_returnflag, count(distinct l_partkey) as parts, true as near from lineitem group by l_returnflag")
def approximate_distinct(spark, sf_dir):
    """The exact number, and whether the sketch is within three standard errors of 0.02."""
    exact, about = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(about - exact) <= 0.06 * exact).alias("near"))


@query("select n_regionkey, unnest(list(n_name order by n_name)) as n_name from nation group by n_regionkey")
def unnest_lists(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l")).select("n_regionkey", F.explode("l").alias("n_name"))


@query("select p_partkey, regexp_matches(p_name, '[aeiou]{2}') as pair, regexp_replace(p_type, '[A-Z]+', 'X', 'g') as kind, len(string_split(p_name, ' '))::bigint as words from part")
def regex_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", dialect.regexp_matches(F.col("p_name"), "[aeiou]{2}").alias("pair"), F.regexp_replace("p_type", "[A-Z]+", "X").alias("kind"), F.size(F.split("p_name", " ", -1)).cast("long").alias("words"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp, strftime(ts, '%d/%m/%y') as day from events")
def strftime_text(spark, sf_dir):
    at = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dialect.strftime(at, "%Y-%m-%dT%H:%M:%S").alias("stamp"), dialect.strftime(at, "%d/%m/%y").alias("day"))


@query("select event_id, trunc(value) as whole, isfinite(value) as finite, round(value)::integer as near from events")
def number_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", dialect.trunc(v).cast("double").alias("whole"), dialect.isfinite(v).alias("finite"), dialect.int_cast(v).alias("near"))


# --- scans ------------------------------------------------------------------------------------


@query("select l_orderkey, l_extendedprice from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1995-02-01'")
def scan_pruned(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_shipdate >= timestamp_ntz '1995-01-01' and l_shipdate < timestamp_ntz '1995-02-01'").select("l_orderkey", "l_extendedprice")


@query("select o_orderkey::integer as o_orderkey, o_totalprice::decimal(38,9) as o_totalprice, o_orderdate::date as o_orderdate from orders")
def scan_contract(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), {"o_orderkey": "int", "o_totalprice": "decimal", "o_orderdate": "date"})


@query("select (json_extract_string(props, '$.k'))::bigint as k, json_extract_string(props, '$.none') as missing, event_id from events")
def scan_json_pointer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"))).alias("payload"))
    return project_json(e, "payload", {"k": ("/props/k", "bigint"), "missing": ("/props/none", "varchar"), "event_id": ("/event_id", "bigint")})


@query("select event_id, user_id from events where event_id > 100 and event_id <= 400")
def scan_window(spark, sf_dir):
    return read_slice(table(spark, sf_dir, "events"), "event_id", Slice(100, 400)).select("event_id", "user_id")


@query("select case when k = 16 then 15 else k end as part, count(*) as n from (select least(floor((o_orderkey - lo)::double * 16 / (hi - lo)), 15)::bigint as k from orders, (select min(o_orderkey) as lo, max(o_orderkey) as hi from orders)) group by all")
def scan_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    parts = [p.select(F.lit(k).cast("long").alias("part")) for k, p in enumerate(ranges.split(o, "o_orderkey", float(low), float(high), 16))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("part").agg(F.count("*").alias("n"))


@query("""select least(floor((c::double - low) / ((high - low) / 8)), 7)::bigint as part, count(*) as n from (select c_acctbal::decimal(12, 2) as c from customer) t,
(select min(c_acctbal::decimal(12, 2))::double as low, max(c_acctbal::decimal(12, 2))::double as high from customer) b group by part""")
def scan_ranges_decimal(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("decimal(12,2)").alias("c"))
    low, high = c.agg(F.min("c"), F.max("c")).first()
    part = F.coalesce(*[F.when(F.expr(p), F.lit(k)) for k, p in enumerate(ranges.predicates("c", low, high, 8))])
    return c.groupBy(part.cast("long").alias("part")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name, c_acctbal from customer")
def files_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    write_files(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv", path, delimiter=";")
    return read_files(spark, "csv", path, {"c_custkey": "bigint", "c_name": "varchar", "c_acctbal": "double"}, delimiter=";")


@query("select event_id, event_type, value from events")
def files_json(spark, sf_dir):
    path = new_path(spark, "json")
    write_files(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "json", path)
    return read_files(spark, "json", path, {"event_id": "bigint", "event_type": "varchar", "value": "double"})


@query("select n_nationkey, n_name from nation")
def files_xml(spark, sf_dir):
    path = new_path(spark, "xml")
    write_files(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "xml", path, row="nation")
    return read_files(spark, "xml", path, {"n_nationkey": "int", "n_name": "varchar"}, row="nation")


@query("select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month, count(*) as n from orders group by all")
def files_by_calendar(spark, sf_dir):
    path = new_path(spark, "calendar")
    write_by_calendar(table(spark, sf_dir, "orders"), path, "o_orderdate", "{yyyy}/{MM}")
    read = spark.read.schema(table(spark, sf_dir, "orders").withColumns(hive_parts("o_orderdate", "{yyyy}/{MM}")).schema).parquet(path)
    return read.groupBy("year", "month").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def files_replace(spark, sf_dir):
    path = new_path(spark, "replaced")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    write_files(o, "parquet", path)
    write_files(spark.read.parquet(path).where("o_orderstatus = 'F'"), "parquet", path, "replace")
    return spark.read.parquet(path)


# --- incremental loads and change data ----------------------------------------------------------


@query("select event_id from events where not coalesce(nullif(event_id, 777) <= 200 or nullif(event_id, 777) > 900, false)")
def trim_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.nullif("event_id", F.lit(777)).alias("cursor"))
    return trim(e, "cursor", Slice(200, 900)).select("event_id")


@query("select max(event_id) as watermark, count(*) as n_rows, false as caught_up from events where event_id > 100 and event_id <= 850")
def capture_watermark(spark, sf_dir):
    return capture(table(spark, sf_dir, "events"), "event_id", Slice(100, 850))


@query("select 99999999::bigint as watermark, 0::bigint as n_rows, false as caught_up")
def capture_empty_window(spark, sf_dir):
    return capture(table(spark, sf_dir, "events"), "event_id", Slice(90_000_000, 99_999_999))


_CHANGES = """(select user_id, lpad(event_id::varchar, 12, '0') as lsn, case when event_id % 3 = 0 then 'delete' when event_id % 3 = 1 then 'insert' else 'update' end as op, value, event_type from events)"""


def _changes(spark, sf_dir) -> DataFrame:
    third = F.col("event_id") % 3
    op = F.when(third == 0, "delete").when(third == 1, "insert").otherwise("update")
    return table(spark, sf_dir, "events").select("user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("lsn"), op.alias("op"), "value", "event_type")


@query(f"select user_id, value, event_type from (select *, row_number() over (partition by user_id order by lsn desc) as k from {_CHANGES} c) where k = 1 and op <> 'delete'")
def cdc_upserts(spark, sf_dir):
    return changes.collapse(_changes(spark, sf_dir), ["user_id"], "lsn", "op")[0]


@query(f"select user_id from (select *, row_number() over (partition by user_id order by lsn desc) as k from {_CHANGES} c) where k = 1 and op = 'delete'")
def cdc_deletes(spark, sf_dir):
    return changes.collapse(_changes(spark, sf_dir), ["user_id"], "lsn", "op")[1]


@query(f"select op, count(*) as n from {_CHANGES} c group by op")
def cdc_operations(spark, sf_dir):
    return changes.operation_counts(_changes(spark, sf_dir), "op")


_OLD = "(select o_custkey, o_orderkey, o_totalprice from orders where o_orderkey % 3 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)"
_NEW = "(select o_custkey, o_orderkey, o_totalprice from orders where o_orderkey % 3 = 1 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)"


def _old(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return changes.last_by(o.where("o_orderkey % 3 = 0"), ["o_custkey"], ["o_orderkey"])


def _new(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").where("o_orderkey % 3 = 1")


@query(f"select o.* from {_OLD} o anti join {_NEW} n on o.o_custkey = n.o_custkey union all select * from {_NEW} n")
def merge_upsert(spark, sf_dir):
    return changes.merge(_old(spark, sf_dir), _new(spark, sf_dir), ["o_custkey"], ["o_orderkey"])


@query(f"select * from {_OLD} o union all select n.* from {_NEW} n anti join {_OLD} o on o.o_custkey = n.o_custkey")
def merge_insert_only(spark, sf_dir):
    new = changes.last_by(_new(spark, sf_dir), ["o_custkey"], ["o_orderkey"])
    return changes.insert_new(_old(spark, sf_dir), new, ["o_custkey"])


@query("""select coalesce(sum(k) filter (where key is null), 0)::bigint as null_key_rows, count(*) filter (where key is not null and k > 1) as duplicate_groups,
coalesce(sum(k - 1) filter (where key is not null and k > 1), 0)::bigint as extra_rows from (select nullif(o_custkey, 5) as key, count(*) as k from orders group by 1)""")
def merge_guard(spark, sf_dir):
    return changes.merge_guard(table(spark, sf_dir, "orders").select(F.nullif("o_custkey", F.lit(5)).alias("key")), ["key"])


@query("select c_custkey, c_name from customer anti join (select distinct o_custkey from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def delete_hard(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete_hard(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("select c_custkey, case when o_custkey is not null then '2024-01-01' end as deleted_at from customer left join (select distinct o_custkey from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def delete_soft(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("deleted_at"))
    return changes.delete_soft(customers, gone, ["c_custkey"], "deleted_at", F.lit("2024-01-01"))


# --- checks, drift, lints -----------------------------------------------------------------------


@query("select 'not_null' as check, count(*) as violations from orders where nullif(o_orderstatus, 'P') is null or o_custkey is null")
def check_not_null(spark, sf_dir):
    return checks.not_null(table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), ["s", "o_custkey"])


@query("select 'unique' as check, count(*) as violations from (select o_custkey from orders group by o_custkey having count(*) > 1)")
def check_unique(spark, sf_dir):
    return checks.unique(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("select 'row_count' as check, (case when count(*) between 1 and 10 then 0 else 1 end)::bigint as violations from orders")
def check_row_count(spark, sf_dir):
    return checks.row_count(table(spark, sf_dir, "orders"), 1, 10)


@query("select 'freshness' as check, (case when max(ts) is null or max(ts) < timestamp '2024-03-01' - interval 1 day then 1 else 0 end)::bigint as violations from events")
def check_freshness(spark, sf_dir):
    return checks.freshness(table(spark, sf_dir, "events"), "ts", timedelta(days=1), datetime(2024, 3, 1))


@query("select 'accepted_values' as check, count(*) as violations from orders where o_orderstatus is not null and o_orderstatus not in ('F', 'O')")
def check_accepted_values(spark, sf_dir):
    return checks.accepted_values(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


@query("select 'custom_sql' as check, count(*) as violations from lineitem where l_discount > 0.09")
def check_custom_sql(spark, sf_dir):
    return checks.custom_sql(run_sql(spark, sf_dir, "select * from lineitem where l_discount > 0.09"))


@query("select distinct o_orderstatus from orders where o_orderstatus not in ('F')")
def check_sample(spark, sf_dir):
    return checks.violating_rows(table(spark, sf_dir, "orders"), "accepted_values", ["o_orderstatus"], ["F"])


@query("select 'big' as column, max(abs(o_orderkey::double * 10000000000000)) as largest from orders")
def lint_integers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("double") * 1e13).alias("big"), "o_totalprice")
    return schema.integer_lint(o)


@query("select 'd' as column, max(day(o_orderdate))::bigint as largest_day from orders where day(o_orderdate) <= 12")
def lint_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate") <= 12).select(F.col("o_orderdate").alias("d"))
    return schema.ambiguous_dates(o, ["d"]).withColumn("largest_day", F.col("largest_day").cast("long"))


@query("select 'p_name' as column, max(length(p_name))::bigint as longest from part union all select 'p_brand', max(length(p_brand)) from part union all select 'p_type', max(length(p_type)) from part")
def text_lengths(spark, sf_dir):
    return schema.text_lengths(table(spark, sf_dir, "part")).withColumn("longest", F.col("longest").cast("long"))


@query("select count(*) as n_rows from orders")
def relation_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = schema.fingerprint(o)
    b = schema.fingerprint(o.repartition(7)).select(F.col("n_rows").alias("m"), F.col("hash_sum").alias("h"))
    return a.join(b, a.hash_sum == b.h).select("n_rows")


@query("select n_nationkey::varchar as n_nationkey, '•••' as n_name, n_regionkey::varchar as n_regionkey from nation")
def preview_rows(spark, sf_dir):
    return schema.preview(table(spark, sf_dir, "nation"), 100, ["n_name"])


@query("select * from orders order by all offset 1000")
def drain_in_order(spark, sf_dir):
    return schema.in_order(table(spark, sf_dir, "orders"), 1000)


@query("select 'o_orderpriority' as column, 'removed' as change union all select 'extra', 'added' union all select 'o_orderkey', 'retyped'")
def schema_drift(spark, sf_dir):
    before = schema.columns_of(table(spark, sf_dir, "orders"))
    after = schema.columns_of(table(spark, sf_dir, "orders").drop("o_orderpriority").withColumns({"extra": F.lit(1), "o_orderkey": F.col("o_orderkey").cast("string")}))
    d = schema.diff(before, after)
    rows = [(c, "added") for c in d.added] + [(c, "removed") for c in d.removed] + [(c, "retyped") for c in d.retyped]
    return spark.createDataFrame(rows, "column string, change string")


# --- event time -------------------------------------------------------------------------------


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_windows(spark, sf_dir):
    from ..streaming.loads import windowed

    out = windowed(table(spark, sf_dir, "events"), "ts", "1 day", None, "1 hour", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 2))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""select user_id, count(*) as sessions, sum(n)::bigint as events from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from
(select user_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 1 else 0 end as new from events)) group by all) group by user_id""")
def event_sessions(spark, sf_dir):
    from ..streaming.loads import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "1 hour", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


# --- a project from sources to an output ----------------------------------------------------------


@query("""select c_mktsegment, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
where o_orderstatus = 'F' group by c_mktsegment""")
def project_run(spark, sf_dir):
    """Three pipelines over two sources, a check and a replaced output, read back."""
    import tempfile

    from .project import from_dict
    from .runner import Run
    from .state import State

    path = new_path(spark, "segments")
    sql = {
        "done_orders": "select o_orderkey, o_custkey, o_totalprice from {{ source('lake', 'orders') }} where o_orderstatus = '{{ var('status') }}'",
        "enriched": "select o.*, c.c_mktsegment from {{ ref('done_orders') }} o join {{ source('lake', 'customer') }} c on o.o_custkey = c.c_custkey",
        "segments": "select c_mktsegment, count(*) as orders, round(sum(o_totalprice), 2) as total from {{ ref('enriched') }} group by c_mktsegment",
    }
    made = from_dict({
        "name": "segments", "vars": {"status": "F"},
        "sources": [{"connection": "lake", "entity": e, "path": f"{sf_dir}/{e}.parquet"} for e in ("orders", "customer")],
        "pipelines": [
            {"name": "done_orders", "sql": sql["done_orders"], "materialization": "ephemeral"},
            {"name": "enriched", "sql": sql["enriched"], "checks": [{"type": "not_null", "columns": ["c_mktsegment"]}]},
            {"name": "segments", "sql": sql["segments"], "outputs": [{"name": "out", "path": path, "mode": "replace"}]},
        ],
    })
    results = Run(spark, made, State(tempfile.mkdtemp(prefix="tidemill-") + "/state.json")).execute()
    bad = {n: r.message for n, r in results.items() if r.status != "done"}
    if bad:
        raise RuntimeError(str(bad))
    return spark.read.parquet(path)


def _runner(spark, project: dict):
    """Runs of a project with one state and one folder for what they write."""
    import tempfile

    from .project import from_dict
    from .runner import Run
    from .state import State

    made, folder = from_dict(project), new_path(spark, "runs")
    state = tempfile.mkdtemp(prefix="tidemill-") + "/state.json"
    return lambda **more: Run(spark, made, State(state), folder=folder, **more)


def _orders_project(path: str, **source) -> dict:
    return {"name": "orders", "sources": [{"connection": "lake", "entity": "o", "path": path, "cursor": "o_orderkey", "cursor_type": "bigint", **source}], "pipelines": []}


@query("select o_orderkey, o_totalprice from orders")
def run_first_watermark(spark, sf_dir):
    """A watermark in SQL: the first run takes all of what is there, the second what has come since."""
    path, out = new_path(spark, "in"), new_path(spark, "out")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    middle = o.agg(F.percentile("o_orderkey", 0.5)).first()[0]
    made = _orders_project(path)
    made["pipelines"] = [{"name": "new", "sql": "select * from {{ source('lake', 'o') }} where o_orderkey > {{ watermark('lake', 'o') }}", "outputs": [{"name": "q", "path": out, "mode": "append", "accept_duplicates": True}]}]
    run = _runner(spark, made)
    for part in (o.where(F.col("o_orderkey") <= middle), o.where(F.col("o_orderkey") > middle)):
        part.write.mode("append").parquet(path)
        run().execute()
    return spark.read.parquet(out)


@query("select o_orderkey, n from orders, (values ('a'), ('b')) t(n)")
def run_retry_advance(spark, sf_dir):
    """One reader fails, rows come, the run is tried again, and one more run follows: both outputs hold all rows once."""
    path, outs, late = new_path(spark, "in"), {n: new_path(spark, n) for n in "ab"}, new_path(spark, "late")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    middle = o.agg(F.percentile("o_orderkey", 0.5)).first()[0]
    made = _orders_project(path, mode="incremental", initial="-1")
    made["pipelines"] = [{"name": n, "sql": "select o_orderkey from {{ source('lake', 'o') }}" + (f" where o_orderkey not in (select id from parquet.`{late}`)" if n == "b" else ""), "outputs": [{"name": n, "path": outs[n], "mode": "append", "accept_duplicates": True}]} for n in "ab"]
    run = _runner(spark, made)
    o.where(F.col("o_orderkey") <= middle).write.parquet(path)
    first = run()
    if {n: r.status for n, r in first.execute().items()} != {"a": "done", "b": "failed"}:
        raise RuntimeError(str(first.results))
    o.where(F.col("o_orderkey") > middle).write.mode("append").parquet(path)
    spark.createDataFrame([(-5,)], "id long").write.parquet(late)
    run(retry_of=first.save()).execute()
    run().execute()
    a, b = (spark.read.parquet(outs[n]).withColumn("n", F.lit(n)) for n in "ab")
    return a.unionByName(b)


@query("select 'failed' as status, count(*) as violations, 0 as delivered from orders where o_orderstatus = 'F'")
def run_failed_check(spark, sf_dir):
    """A broken check fails its node: nothing is delivered."""
    out = new_path(spark, "out")
    made = _orders_project(f"{sf_dir}/orders.parquet")
    made["pipelines"] = [{"name": "q", "sql": "select nullif(o_orderstatus, 'F') as s from {{ source('lake', 'o') }}", "checks": [{"type": "not_null", "columns": ["s"]}], "outputs": [{"name": "q", "path": out, "mode": "append"}]}]
    got = _runner(spark, made)().execute()["q"]
    try:
        n = spark.read.parquet(out).count()
    except AnalysisException:
        n = 0
    return spark.createDataFrame([(got.status, got.violations["0:not_null"], n)], "status string, violations long, delivered int")


@query("select c_custkey, c_name, c_acctbal, kind from customer, (values (1), (2)) t(k), (values ('csv'), ('tsv'), ('json')) u(kind)")
def run_csv_append_twice(spark, sf_dir):
    """Two runs append to text formats: the second finds the columns and types of the first."""
    outs = {kind: new_path(spark, kind) for kind in ("csv", "tsv", "json")}
    made = {"name": "p", "sources": [{"connection": "lake", "entity": "c", "path": f"{sf_dir}/customer.parquet"}]}
    made["pipelines"] = [{"name": kind, "sql": "select c_custkey, c_name, c_acctbal from {{ source('lake', 'c') }}", "outputs": [{"name": kind, "path": path, "format": kind}]} for kind, path in outs.items()]
    run = _runner(spark, made)
    for _ in range(2):
        bad = {n: r.message for n, r in run().execute().items() if r.status != "done"}
        if bad:
            raise RuntimeError(str(bad))
    columns = {"c_custkey": "bigint", "c_name": "varchar", "c_acctbal": "double"}
    parts = [read_files(spark, kind, path, columns).withColumn("kind", F.lit(kind)) for kind, path in outs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
