"""Replica against replica, and access log against independently observed changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.canon import canonicalize, with_canonical
from chainlake.operators.events import is_projectable, observed_members, parse_deployment
from chainlake.operators.fold import ordered_fold
from chainlake.operators.scan import BUCKET_ROWS, bucket_of, dense_ordinal, longest_key
from chainlake.schemas import DEPLOYMENT_CHAIN, ZERO_HASH
from chainlake.session import materialize


def compare_heads(heads: DataFrame, mode: str = "code") -> DataFrame:
    """Replica heads that differ from the baseline replica of their chain.

    ``heads``: replica_id, ordinal, chain_id, head, entry_count; an unreadable head is
    null. Mode ``code``: the baseline is the first replica with a non-zero head and only
    later replicas are compared. Mode ``spec``: the lowest ordinal is the baseline and
    entry counts are compared too.
    """
    readable = heads.filter("head IS NOT NULL")
    candidate = F.lit(True) if mode == "spec" else F.col("head") != ZERO_HASH
    base = readable.filter(candidate).groupBy("chain_id").agg(
        F.min("ordinal").alias("base_ordinal"),
        F.min_by("head", "ordinal").alias("baseline"),
        F.min_by("entry_count", "ordinal").alias("base_count"),
    )
    differs = F.col("head") != F.col("baseline")
    if mode == "spec":
        differs = differs | (F.col("entry_count") != F.col("base_count"))
    return (
        readable.join(base, "chain_id")
        .filter((F.col("ordinal") > F.col("base_ordinal")) & differs)
        .select(
            "chain_id",
            "replica_id",
            "head",
            "baseline",
            F.concat_ws("@", "chain_id", "replica_id").alias("divergence"),
        )
    )


def chain_universe(entries: DataFrame) -> DataFrame:
    """The deployment chain and every user chain, once each."""
    deployment = entries.sparkSession.createDataFrame([(DEPLOYMENT_CHAIN,)], "chain_id STRING")
    return entries.select("chain_id").union(deployment).distinct()


def process1(heads: DataFrame, mode: str = "code", active: DataFrame | None = None) -> DataFrame:
    """One row: chains checked and diverging across replicas, deployment chain apart.

    ``active`` (chain_id) limits the check to those chains.
    """
    if active is not None:
        heads = heads.join(active.select("chain_id").distinct(), "chain_id", "left_semi")
    bad = compare_heads(heads, mode)
    tagged = heads.select("chain_id", F.lit(0).cast("bigint").alias("bad")).unionByName(
        bad.select("chain_id", F.lit(1).cast("bigint").alias("bad"))
    )
    chains = tagged.groupBy("chain_id").agg(F.sum("bad").alias("bad"))
    user = F.col("chain_id") != DEPLOYMENT_CHAIN
    return chains.agg(
        F.count_if(user).alias("user_chains_checked"),
        F.count_if(user & (F.col("bad") > 0)).alias("user_chains_divergent"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("head_divergences"),
        F.coalesce(F.bool_or(~user & (F.col("bad") > 0)), F.lit(False)).alias("deployment_divergent"),
    )


def compare_collections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Collections (name, digest) whose digests differ or that only one side has."""
    left = a.select("name", F.col("digest").alias("digest_a"))
    right = b.select("name", F.col("digest").alias("digest_b"))
    return left.join(right, "name", "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def observer_missing(proxy: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed payloads the access log does not contain, as a multiset difference."""
    return observed.select("payload").exceptAll(proxy.select("payload"))


def process2(
    proxy: DataFrame,
    observer: DataFrame,
    salt: str,
    cursor_prx: int = 0,
    cursor_obs: int = 0,
    limit: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Pair the i-th projectable log entry with the i-th observed entry; one result row.

    Both inputs are one chain each with dense indexes. ``limit`` reads at most that many
    entries per side, as one page. Observed text may have its members in any order; a side
    without canonical text is named in ``canon_error_side``.
    """
    prx = proxy.filter(F.col("index") >= cursor_prx)
    obs = observer.filter(F.col("index") >= cursor_obs)
    if limit is not None:
        prx = prx.filter(F.col("index") < cursor_prx + limit)
        obs = obs.filter(F.col("index") < cursor_obs + limit)
    fields = parse_deployment(prx.select("index", "payload_type", "payload_json"))
    members = observed_members(salt, F.col("p.actor_id"), F.col("p.details")["query_fingerprint"])
    members["action"], members["resource"] = F.col("p.action"), F.col("p.resource")
    projected = with_canonical(fields.filter(is_projectable()), {"prx_json": members}).select(
        "index", "prx_json"
    )
    # Stored, because numbering reads the rows of a long chain twice and each reading would parse all texts again.
    projected = materialize(projected, "projected", compression="zstd")
    read = prx.agg(F.count("*")).first()[0]
    numbered = dense_ordinal(
        projected, [], ["index"], bucket_of(F.col("index"), bucket_rows), "ordinal", read, bucket_rows
    )
    left = numbered.select("ordinal", F.col("index").alias("prx_index"), "prx_json")
    right = obs.select(
        (F.col("index") - cursor_obs).alias("ordinal"),
        F.col("index").alias("obs_index"),
        F.col("payload_json").alias("obs_raw"),
    )
    pairs = left.join(right, "ordinal", "full_outer")
    paired = F.col("prx_index").isNotNull() & F.col("obs_index").isNotNull()
    # The proxy's text is canonical, so text equal to it is too; only the rest is parsed.
    equal = F.coalesce(F.col("prx_json") == F.col("obs_raw"), F.lit(False))
    pairs = pairs.withColumn("parsed", canonicalize(F.when(paired & ~equal, F.col("obs_raw"))))
    pairs = pairs.withColumns(
        {
            "prx_bad": F.col("prx_json").isNull(),
            "obs_bad": ~equal & F.col("parsed.canonical").isNull(),
        }
    )
    wrong = paired & ~equal & ~F.coalesce(F.col("prx_json") == F.col("parsed.canonical"), F.lit(False))
    detail = F.struct("ordinal", "prx_index", "obs_index", "prx_json", "obs_raw", "prx_bad", "obs_bad")
    none = F.lit(None).cast("bigint")
    walked = pairs.agg(
        F.min_by(F.when(wrong, detail), F.when(wrong, F.col("ordinal"))).alias("bad"),
        F.count_if(paired).alias("pairs"),
        F.min_by(
            "prx_index", F.when(F.col("prx_index").isNotNull() & ~paired, F.col("ordinal"))
        ).alias("waiting"),
    ).select("bad", "pairs", "waiting", *[none.alias(c) for c in ("last_read", "prx_total", "obs_total")])
    # One-row totals of both sides, folded in by an aggregate over three rows.
    totals = prx.agg(F.max("index").alias("last_read")).unionByName(
        proxy.agg((F.max("index") + 1).alias("prx_total")), allowMissingColumns=True
    ).unionByName(observer.agg((F.max("index") + 1).alias("obs_total")), allowMissingColumns=True)
    row = walked.unionByName(totals, allowMissingColumns=True).agg(
        F.first("bad", ignorenulls=True).alias("bad"),
        F.max("pairs").alias("pairs"),
        F.max("waiting").alias("waiting"),
        F.coalesce(F.max("last_read") + 1, F.lit(cursor_prx)).alias("after_page"),
        F.coalesce(F.max("prx_total"), F.lit(0)).alias("prx_total"),
        F.coalesce(F.max("obs_total"), F.lit(0)).alias("obs_total"),
    )
    verified = F.coalesce("bad.ordinal", "pairs")
    new_prx = F.coalesce("bad.prx_index", "waiting", "after_page")
    new_obs = F.coalesce("bad.obs_index", F.lit(cursor_obs) + F.col("pairs"))
    return row.select(
        F.col("bad").isNotNull().alias("divergent"),
        verified.cast("bigint").alias("entries_verified"),
        new_prx.cast("bigint").alias("cursor_prx"),
        new_obs.cast("bigint").alias("cursor_obs"),
        F.greatest(
            F.col("prx_total") - new_prx, F.col("obs_total") - new_obs, F.lit(0)
        ).cast("bigint").alias("tail_depth"),
        F.col("bad.prx_json").alias("proxy_payload"),
        F.col("bad.obs_raw").alias("observed_payload"),
        F.when(F.col("bad.prx_bad") & F.col("bad.obs_bad"), "both")
        .when(F.col("bad.prx_bad"), "proxy")
        .when(F.col("bad.obs_bad"), "observer")
        .alias("canon_error_side"),
    )


def tail_depth(prx_total: Column, cursor_prx: Column, obs_total: Column, cursor_obs: Column) -> Column:
    """Entries not yet compared on the longer side."""
    return F.greatest(prx_total - cursor_prx, obs_total - cursor_obs, F.lit(0))


def verification_failure_rows(outcome: DataFrame, chain_id: str = DEPLOYMENT_CHAIN) -> DataFrame:
    """System event for each diverging ``process2`` outcome, payloads in hex."""
    details = F.map_filter(
        F.create_map(
            F.lit("process"),
            F.lit("2"),
            F.lit("chain_id"),
            F.lit(chain_id),
            F.lit("cursor_prx"),
            F.col("cursor_prx").cast("string"),
            F.lit("cursor_obs"),
            F.col("cursor_obs").cast("string"),
            F.lit("proxy_payload"),
            F.lower(F.hex(F.encode("proxy_payload", "UTF-8"))),
            F.lit("observed_payload"),
            F.lower(F.hex(F.encode("observed_payload", "UTF-8"))),
            F.lit("canon_error_side"),
            F.col("canon_error_side"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return outcome.filter("divergent").select(
        F.lit("system:verifier").alias("actor_id"),
        F.lit("system").alias("actor_type"),
        F.lit("verification_failure").alias("category"),
        F.lit("read").alias("action"),
        F.lit(chain_id).alias("resource"),
        F.lit("process 2: observer-proxy payload byte mismatch").alias("scope"),
        details.alias("details"),
    )


def running_hash(payloads: DataFrame, key: str, index: str, canonical: str, **kwargs) -> DataFrame:
    """Ordered digest per key: state = SHA-256(state || payload), from 32 zero octets.

    ``index`` is dense per key. One row per key with the final state.
    """
    def step(state, text):
        data = bytes.fromhex(state or ZERO_HASH) + text.encode("utf-8")
        digest = hashlib.sha256(data).hexdigest()
        return digest, (digest,)

    states = ordered_fold(
        payloads.select(key, index, canonical),
        key,
        index,
        step,
        [canonical],
        [T.StructField("state", T.StringType())],
        None,
        longest_key(payloads, [key]),
        **kwargs,
    )
    return states.groupBy(key).agg(
        F.count("*").alias("payloads"), F.max_by("state", index).alias("running_hash")
    )


def row_text(columns: list[str]) -> Column:
    """Null-safe text of a row: each value with its length, ``~`` for null."""
    def one(c: str) -> Column:
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(s), F.lit(":"), s), F.lit("~"))

    return F.concat_ws("|", *[one(c) for c in columns])


def table_leaves(table: DataFrame, pk: str, columns: list[str], leaf_keys: int = 4096) -> DataFrame:
    """Digest per key range of an integer primary key: leaf = floor(pk / leaf_keys).

    Row digests are taken first, so a leaf gathers at most ``leaf_keys`` short strings.
    """
    rows = table.select(
        F.floor(F.col(pk) / leaf_keys).cast("bigint").alias("leaf"),
        F.col(pk).alias("__pk"),
        F.sha2(row_text(columns), 256).alias("__digest"),
    )
    return rows.groupBy("leaf").agg(
        F.count("*").alias("row_count"),
        F.sha2(_ordered_concat(), 256).alias("digest"),
    )


def _ordered_concat() -> Column:
    pairs = F.array_sort(F.collect_list(F.struct("__pk", "__digest")))
    return F.array_join(F.transform(pairs, lambda p: p["__digest"]), "")


def digest_tree(leaves: DataFrame, fan_in: int = 4096, levels: int = 2) -> DataFrame:
    """Hash leaf digests upwards, ``fan_in`` per node, to one root row (row_count, digest).

    ``levels`` of ``fan_in`` leaves cover fan_in ** levels leaves; both sides of a
    comparison must use the same numbers.
    """
    nodes = leaves.select(F.col("leaf").alias("__pk"), F.col("digest").alias("__digest"), "row_count")
    for level in range(levels):
        parent = F.lit(0) if level == levels - 1 else F.floor(F.col("__pk") / fan_in)
        nodes = (
            nodes.withColumn("__parent", parent.cast("bigint"))
            .groupBy("__parent")
            .agg(F.sum("row_count").alias("row_count"), F.sha2(_ordered_concat(), 256).alias("__digest"))
            .select(F.col("__parent").alias("__pk"), "__digest", "row_count")
        )
    return nodes.select("row_count", F.col("__digest").alias("digest"))


def table_checksum(
    table: DataFrame, pk: str, columns: list[str], leaf_keys: int = 4096, levels: int = 2
) -> DataFrame:
    """One digest of a table in key order; an empty table has the digest of ``empty``."""
    root = digest_tree(table_leaves(table, pk, columns, leaf_keys), levels=levels)
    # A global aggregate returns its one row also when there are no leaves.
    return root.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("digest"), F.sha2(F.lit("empty"), 256)).alias("digest"),
    )


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Key ranges in which two copies of a table differ, from their ``table_leaves``."""
    left = a.select("leaf", F.col("digest").alias("digest_a"), F.col("row_count").alias("rows_a"))
    right = b.select("leaf", F.col("digest").alias("digest_b"), F.col("row_count").alias("rows_b"))
    return left.join(right, "leaf", "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def full_state_checksum(digests: DataFrame) -> DataFrame:
    """One digest over the table digests (name, digest), tables in name order."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "digest")))
    text = F.array_join(F.transform(pairs, lambda p: p["digest"]), "")
    return digests.agg(F.count("*").alias("tables"), F.sha2(F.unhex(text), 256).alias("digest"))


def manifest_hash(objects: DataFrame, prefix_digits: int = 3) -> DataFrame:
    """Digest of an object listing (bucket, key, etag), one row per bucket.

    Objects are grouped by the leading hex digits of the digest of their key, which
    spreads any bucket evenly; within a group they are in key order as ``key:etag;``.
    """
    rows = objects.select(
        "bucket",
        F.left(F.sha2("key", 256), F.lit(prefix_digits)).alias("leaf"),
        F.col("key").alias("__pk"),
        F.sha2(F.concat("key", F.lit(":"), "etag", F.lit(";")), 256).alias("__digest"),
    )
    leaves = rows.groupBy("bucket", "leaf").agg(
        F.count("*").alias("objects"), F.sha2(_ordered_concat(), 256).alias("__digest")
    )
    return (
        leaves.withColumnRenamed("leaf", "__pk")
        .groupBy("bucket")
        .agg(F.sum("objects").alias("objects"), F.sha2(_ordered_concat(), 256).alias("digest"))
    )


def compare_states(pairs: DataFrame) -> DataFrame:
    """Match or divergence of two digests per row (digest_a, digest_b)."""
    same = F.col("digest_a").eqNullSafe(F.col("digest_b"))
    return pairs.withColumn("outcome", F.when(same, "match").otherwise("divergence"))
