"""Replica heads, table digests, index ranges, eviction, acknowledgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import compare, ops, ranges
from chainlake.operators.read import chain_heads
from chainlake.plans import fixtures as fx
from chainlake.plans.registry import query
from chainlake.schemas import ZERO_HASH


def replica_heads(spark, sf_dir):
    """Five replicas of a head per customer; some heads differ, are unread or empty."""
    c = fx.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") == 0, "_deployment").otherwise(F.col("c_name")).alias("chain_id"),
        F.col("c_custkey").alias("k"),
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ordinal"),
    )
    good = F.sha2("chain_id", 256)
    head = (
        F.when((F.col("ordinal") == 0) & (F.col("k") % 5 == 0), ZERO_HASH)
        .when((F.col("ordinal") == 1) & (F.col("k") % 7 == 0), F.lit(None).cast("string"))
        .when((F.col("ordinal") == 3) & (F.col("k") % 11 == 0), F.sha2(good, 256))
        .otherwise(good)
    )
    count = F.when((F.col("ordinal") == 4) & (F.col("k") % 13 == 0), 9).otherwise(10)
    return c.select(
        "chain_id",
        F.concat(F.lit("r"), "ordinal").alias("replica_id"),
        "ordinal",
        head.alias("head"),
        count.cast("bigint").alias("entry_count"),
    )


HEADS_SQL = f"""WITH h AS (
  SELECT CASE WHEN c_custkey = 0 THEN '_deployment' ELSE c_name END AS chain_id, c_custkey AS k,
    unnest(range(5)) AS ordinal FROM customer),
heads AS (SELECT chain_id, 'r' || ordinal AS replica_id, ordinal,
  CASE WHEN ordinal = 0 AND k % 5 = 0 THEN '{ZERO_HASH}' WHEN ordinal = 1 AND k % 7 = 0 THEN NULL
    WHEN ordinal = 3 AND k % 11 = 0 THEN sha256(sha256(chain_id)) ELSE sha256(chain_id) END AS head,
  CASE WHEN ordinal = 4 AND k % 13 = 0 THEN 9 ELSE 10 END AS entry_count FROM h)"""


def _baseline_sql(condition: str) -> str:
    return f"""base AS (SELECT chain_id, ordinal AS o, head AS baseline, entry_count AS n FROM heads
      WHERE head IS NOT NULL AND {condition}
      QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY ordinal) = 1)"""


@query(
    "compare_heads",
    f"""{HEADS_SQL}, {_baseline_sql(f"head != '{ZERO_HASH}'")}
    SELECT chain_id, replica_id, chain_id || '@' || replica_id AS divergence FROM heads JOIN base USING (chain_id)
    WHERE ordinal > o AND head != baseline""",
)
def compare_heads(spark, sf_dir):
    return compare.compare_heads(replica_heads(spark, sf_dir)).select("chain_id", "replica_id", "divergence")


@query(
    "compare_heads_spec",
    f"""{HEADS_SQL}, {_baseline_sql("true")}
    SELECT chain_id, replica_id, chain_id || '@' || replica_id AS divergence FROM heads JOIN base USING (chain_id)
    WHERE ordinal > o AND head IS NOT NULL AND (head != baseline OR entry_count != n)""",
)
def compare_heads_spec(spark, sf_dir):
    rows = compare.compare_heads(replica_heads(spark, sf_dir), mode="spec")
    return rows.select("chain_id", "replica_id", "divergence")


_PROCESS1_SQL = f"""{HEADS_SQL}, {_baseline_sql(f"head != '{ZERO_HASH}'")},
bad AS (SELECT chain_id FROM heads JOIN base USING (chain_id) WHERE ordinal > o AND head != baseline)"""


@query(
    "process1",
    f"""{_PROCESS1_SQL}
    SELECT (SELECT count(DISTINCT chain_id) FROM heads WHERE chain_id != '_deployment') AS user_chains_checked,
      (SELECT count(DISTINCT chain_id) FROM bad WHERE chain_id != '_deployment') AS user_chains_divergent,
      (SELECT count(*) FROM bad) AS head_divergences,
      (SELECT count(*) > 0 FROM bad WHERE chain_id = '_deployment') AS deployment_divergent""",
)
def process1(spark, sf_dir):
    return compare.process1(replica_heads(spark, sf_dir))


@query(
    "verification_report",
    f"""{_PROCESS1_SQL}
    SELECT (SELECT count(DISTINCT chain_id) FROM heads WHERE chain_id != '_deployment') AS user_chains_checked,
      (SELECT count(*) FROM bad) AS head_divergences, false AS clean, true AS observer_divergent,
      (SELECT count(*) // 2 FROM events WHERE event_type IN ('click', 'error')) AS observer_entries_verified""",
)
def verification_report(spark, sf_dir):
    from chainlake.plans.observer import _altered

    outcome = compare.process2(*_altered(spark, sf_dir), fx.SALT)
    report = ops.verification_report(compare.process1(replica_heads(spark, sf_dir)), outcome)
    return report.select(
        "user_chains_checked", "head_divergences", "clean", "observer_divergent", "observer_entries_verified"
    )


@query(
    "chain_universe",
    f"""WITH {fx.PAYLOADS_SQL} SELECT DISTINCT chain_id FROM payloads""",
)
def chain_universe(spark, sf_dir):
    rows = fx.chains(spark, sf_dir).filter(F.col("chain_id") != "_deployment")
    return compare.chain_universe(rows)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
#: Money is a double in the driver tables; its text is the same everywhere only as a decimal.
MONEY = ("o_totalprice", "c_acctbal", "p_retailprice")


def _whole(spark, sf_dir: str, name: str):
    rows = fx.table(spark, sf_dir, name)
    return rows.withColumns({c: F.col(c).cast("decimal(15,2)") for c in rows.columns if c in MONEY})


def _row_text_sql(columns: list[str]) -> str:
    one = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '~')"
    return " || '|' || ".join(one.format(f"CAST({c} AS DECIMAL(15,2))" if c in MONEY else c) for c in columns)


def _checksum_sql(source: str, pk: str, columns: list[str], leaf_keys: int, levels: int, fan_in: int = 4096) -> str:
    steps = f"""n0 AS (SELECT {pk} // {leaf_keys} AS id, count(*) AS n,
      sha256(string_agg(sha256({_row_text_sql(columns)}), '' ORDER BY {pk})) AS digest FROM {source} GROUP BY 1)"""
    for level in range(levels):
        parent = "0" if level == levels - 1 else f"id // {fan_in}"
        steps += f""", n{level + 1} AS (SELECT {parent} AS id, sum(n) AS n,
          sha256(string_agg(digest, '' ORDER BY id)) AS digest FROM n{level} GROUP BY 1)"""
    return steps


@query(
    "table_checksum",
    f"""WITH {_checksum_sql('orders', 'o_orderkey', ORDER_COLUMNS, 512, 2)}
    SELECT CAST(n AS BIGINT) AS row_count, digest FROM n2""",
)
def table_checksum(spark, sf_dir):
    return compare.table_checksum(_whole(spark, sf_dir, "orders"), "o_orderkey", ORDER_COLUMNS, leaf_keys=512)


@query("table_checksum_empty", "SELECT CAST(0 AS BIGINT) AS row_count, sha256('empty') AS digest")
def table_checksum_empty(spark, sf_dir):
    none = fx.table(spark, sf_dir, "orders").filter("o_orderkey < 0")
    return compare.table_checksum(none, "o_orderkey", ORDER_COLUMNS)


@query(
    "table_fingerprint_divergence",
    """SELECT o_orderkey // 512 AS leaf, count(*) AS rows_a,
      count(*) FILTER (o_orderkey % 1000 != 9) AS rows_b FROM orders
    GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 1000 IN (7, 9)) > 0""",
)
def table_fingerprint_divergence(spark, sf_dir):
    """A copy with the price of one order in a thousand changed and one order missing."""
    a = _whole(spark, sf_dir, "orders")
    b = a.filter("o_orderkey % 1000 != 9").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    )
    leaves = [compare.table_leaves(t, "o_orderkey", ORDER_COLUMNS, 512) for t in (a, b)]
    return compare.differing_leaves(*leaves).select("leaf", "rows_a", "rows_b")


_STATE = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_orderkey", ORDER_COLUMNS),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
}


@query(
    "full_state_checksum",
    "WITH "
    + ", ".join(
        _checksum_sql(t, pk, cols, 4096, 2).replace("n0", f"{t}0").replace("n1", f"{t}1").replace("n2", f"{t}2")
        for t, (pk, cols) in _STATE.items()
    )
    + """ SELECT CAST(3 AS BIGINT) AS tables, sha256(unhex(customer2.digest || orders2.digest || part2.digest)) AS digest
    FROM customer2, orders2, part2""",
)
def full_state_checksum(spark, sf_dir):
    parts = None
    for name, (pk, columns) in _STATE.items():
        digest = compare.table_checksum(_whole(spark, sf_dir, name), pk, columns).select(
            F.lit(name).alias("name"), "digest"
        )
        parts = digest if parts is None else parts.unionByName(digest)
    return compare.full_state_checksum(parts)


@query(
    "manifest_hash",
    """WITH o AS (SELECT l_returnflag AS bucket, 'k/' || l_orderkey || '/' || l_partkey || '/' || l_suppkey AS key,
        max(md5(l_linestatus || l_linenumber)) AS etag FROM lineitem GROUP BY ALL),
    leaves AS (SELECT bucket, substr(sha256(key), 1, 2) AS leaf, count(*) AS n,
      sha256(string_agg(sha256(key || ':' || etag || ';'), '' ORDER BY key)) AS digest FROM o GROUP BY ALL)
    SELECT bucket, CAST(sum(n) AS BIGINT) AS objects, sha256(string_agg(digest, '' ORDER BY leaf)) AS digest
    FROM leaves GROUP BY bucket""",
)
def manifest_hash(spark, sf_dir):
    key = F.concat(F.lit("k/"), "l_orderkey", F.lit("/"), "l_partkey", F.lit("/"), "l_suppkey")
    objects = (
        fx.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("bucket"), key.alias("key"))
        .agg(F.max(F.md5(F.concat("l_linestatus", "l_linenumber"))).alias("etag"))
    )
    return compare.manifest_hash(objects, prefix_digits=2)


@query(
    "compare_collections",
    """WITH a AS (SELECT l_returnflag AS name, sha256(CAST(count(*) AS VARCHAR)) AS digest_a FROM lineitem GROUP BY 1),
    b AS (SELECT l_returnflag AS name, sha256(CAST(count(*) + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS VARCHAR))
      AS digest_b FROM lineitem WHERE l_returnflag != 'R' GROUP BY l_returnflag)
    SELECT name, digest_a, digest_b FROM a FULL JOIN b USING (name) WHERE digest_a IS DISTINCT FROM digest_b""",
)
def compare_collections(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).count()
    a = counts.select("name", F.sha2(F.col("count").cast("string"), 256).alias("digest"))
    changed = F.col("count") + F.when(F.col("name") == "N", 1).otherwise(0)
    b = counts.filter("name != 'R'").select("name", F.sha2(changed.cast("string"), 256).alias("digest"))
    return compare.compare_collections(a, b)


@query(
    "compare_states",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'divergence' ELSE 'match' END AS outcome FROM orders""",
)
def compare_states(spark, sf_dir):
    a = F.sha2(F.col("o_custkey").cast("string"), 256)
    pairs = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        a.alias("digest_a"),
        F.when(F.col("o_orderkey") % 1000 == 7, F.sha2(a, 256)).otherwise(a).alias("digest_b"),
    )
    return compare.compare_states(pairs).select("o_orderkey", "outcome")


def index_ranges(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chain_id"),
        ((F.col("l_orderkey") * 7) % 5000).alias("from_index"),
        ((F.col("l_orderkey") * 7) % 5000 + F.col("l_linenumber")).cast("bigint").alias("to_index"),
        F.col("l_orderkey").alias("at"),
    )


RANGES_SQL = """r AS (SELECT CAST(l_suppkey AS VARCHAR) AS chain_id, (l_orderkey * 7) % 5000 AS f,
  (l_orderkey * 7) % 5000 + l_linenumber AS t, l_orderkey AS stamp FROM lineitem),
flagged AS (SELECT *, CASE WHEN f <= max(t) OVER w + 1 THEN 0 ELSE 1 END AS opens FROM r
  WINDOW w AS (PARTITION BY chain_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY chain_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
merged AS (SELECT chain_id, min(f) AS from_index, max(t) AS to_index, max(stamp) AS stamp FROM islands GROUP BY chain_id, island)"""


# Intervals with one start are one interval up to their largest end, so that the order by start is total:
# with ties each window could order them otherwise, and an island then began behind its first interval.
MERGE_SQL = """r AS (SELECT CAST(l_suppkey AS VARCHAR) AS chain_id, (l_orderkey * 7) % 5000 AS f,
  max((l_orderkey * 7) % 5000 + l_linenumber) AS t, max(l_orderkey) AS stamp FROM lineitem GROUP BY 1, 2),
flagged AS (SELECT *, CASE WHEN f <= max(t) OVER w + 1 THEN 0 ELSE 1 END AS opens FROM r
  WINDOW w AS (PARTITION BY chain_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY chain_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
merged AS (SELECT chain_id, min(f) AS from_index, max(t) AS to_index, max(stamp) AS stamp FROM islands GROUP BY chain_id, island)"""


@query("merge_ranges", f"WITH {MERGE_SQL} SELECT chain_id, from_index, to_index, stamp FROM merged")
def merge_ranges(spark, sf_dir):
    return ranges.merge_ranges(index_ranges(spark, sf_dir)).withColumnRenamed("at", "stamp")


@query("merge_ranges_large_keys", f"WITH {MERGE_SQL} SELECT chain_id, from_index, to_index, stamp FROM merged")
def merge_ranges_large_keys(spark, sf_dir):
    """Every chain counts as too large for one task and is merged bucket by bucket."""
    merged = ranges.merge_ranges(index_ranges(spark, sf_dir), bucket_rows=512)
    return merged.withColumnRenamed("at", "stamp")


@query(
    "range_coverage",
    f"""WITH {RANGES_SQL}, wanted AS (SELECT DISTINCT chain_id, CAST(chain_id AS BIGINT) % 6 AS last_index FROM r)
    SELECT w.chain_id, last_index, coalesce(to_index >= last_index, false) AS covered
    FROM wanted w LEFT JOIN merged m ON m.chain_id = w.chain_id AND m.from_index = 0""",
)
def range_coverage(spark, sf_dir):
    rows = index_ranges(spark, sf_dir)
    wanted = rows.select("chain_id", (F.col("chain_id").cast("bigint") % 6).alias("last_index")).distinct()
    return ranges.covered_from_zero(ranges.merge_ranges(rows), wanted)


@query("last_verified_index", f"WITH {RANGES_SQL} SELECT chain_id, max(t) AS last_verified FROM r GROUP BY chain_id")
def last_verified_index(spark, sf_dir):
    return ranges.last_verified_index(index_ranges(spark, sf_dir))


@query(
    "range_status",
    f"""WITH {RANGES_SQL}, e AS (SELECT o_orderkey, CAST(o_custkey % 101 AS VARCHAR) AS chain_id,
      (o_orderkey * 3) % 5003 AS "index" FROM orders)
    SELECT o_orderkey, e.chain_id, "index" FROM e WHERE EXISTS (SELECT 1 FROM merged m
      WHERE m.chain_id = e.chain_id AND e."index" BETWEEN m.from_index AND m.to_index)""",
)
def range_status(spark, sf_dir):
    entries = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 101).cast("string").alias("chain_id"),
        ((F.col("o_orderkey") * 3) % 5003).alias("index"),
    )
    return ranges.range_status(entries, index_ranges(spark, sf_dir), width=256)


@query(
    "eviction_plan",
    """WITH c AS (SELECT c_name AS chain_id, c_custkey AS k, (c_custkey * 7919) % 100000 AS modified_ms,
      1000 + c_custkey % 50 AS bytes, c_custkey % 4 AS entry_count FROM customer),
    ok AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY modified_ms, chain_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM c
      WHERE k % 5 != 1 AND (entry_count = 0 OR (k % 3 != 1 AND k % 7 != 2)))
    SELECT chain_id, CAST(freed_before AS BIGINT) AS freed_before FROM ok
    WHERE freed_before < (SELECT sum(bytes) // 3 FROM c)""",
)
def eviction_plan(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    chains = c.select(
        F.col("c_name").alias("chain_id"),
        ((k * 7919) % 100000).alias("modified_ms"),
        (1000 + k % 50).alias("bytes"),
        (k % 4).alias("entry_count"),
    )

    def upto(kept):
        return c.filter(kept).select(
            F.col("c_name").alias("chain_id"),
            F.lit(0).cast("bigint").alias("from_index"),
            F.greatest(k % 4 - 1, F.lit(0)).alias("to_index"),
            F.lit(1).cast("bigint").alias("at"),
        )

    copies = c.filter(k % 7 != 2).select(F.col("c_name").alias("chain_id"), F.greatest(k % 4 - 1, F.lit(0)).alias("index"))
    used = chains.agg(F.sum("bytes")).first()[0]
    plan = ranges.eviction_plan(
        chains, upto(k % 5 != 1), upto(k % 3 != 1), copies, used - used // 3, bucket_rows=100
    )
    return plan.select("chain_id", F.col("freed_before").cast("bigint"))


@query(
    "quorum_ack",
    """SELECT CAST(l_suppkey AS VARCHAR) AS chain_id, l_orderkey AS "index",
      count(DISTINCT l_linenumber % 5) FILTER (l_returnflag != 'R') AS acked,
      count(DISTINCT l_linenumber % 5) FILTER (l_returnflag != 'R') >= 2 AS durable
    FROM lineitem GROUP BY 1, 2""",
)
def quorum_ack(spark, sf_dir):
    writes = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chain_id"),
        F.col("l_orderkey").alias("index"),
        (F.col("l_linenumber") % 5).alias("replica_id"),
        (F.col("l_returnflag") != "R").alias("ok"),
    )
    return ops.quorum_ack(writes, replica_count=3)


@query(
    "chain_heads_by_time",
    f"""WITH {fx.PAYLOADS_SQL} SELECT chain_id, count(*) AS entry_count,
      arg_max(ts, idx) AS last_timestamp FROM payloads GROUP BY chain_id""",
)
def chain_heads_by_time(spark, sf_dir):
    return chain_heads(fx.chains(spark, sf_dir)).drop("head")
