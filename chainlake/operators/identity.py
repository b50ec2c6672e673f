"""Who made a call: application, suspicious, or a named administrator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IdentityConfig:
    """Known application callers. Hostname sources must be given as their addresses."""

    mode: str = "source_credential"
    app_sources: tuple[str, ...] = ()
    app_credentials: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _is_app_credential(config: IdentityConfig) -> Column:
    if not config.app_credentials:
        return F.lit(False)
    known = F.create_map(
        *[
            part
            for protocol, names in sorted(config.app_credentials.items())
            for part in (F.lit(protocol), F.array(*[F.lit(n) for n in names]))
        ]
    )
    listed = F.try_element_at(known, F.col("protocol"))
    return F.coalesce(F.array_contains(listed, F.col("credential")), F.lit(False))


def classify_identity(calls: DataFrame, config: IdentityConfig) -> DataFrame:
    """Add ``caller_class`` (app, suspicious, admin) and ``caller``.

    ``calls`` has source_ip, credential and protocol. The config holds a handful of
    values and travels as literals, so nothing is shuffled or joined.
    """
    by_credential = _is_app_credential(config)
    credential = F.coalesce("credential", F.lit("unknown"))
    if config.mode == "credential":
        return calls.withColumns(
            {
                "caller_class": F.when(by_credential, "app").otherwise("admin"),
                "caller": credential,
            }
        )
    sources = [s.removesuffix("/32") for s in config.app_sources]
    by_source = F.coalesce(F.col("source_ip").isin(sources), F.lit(False)) if sources else F.lit(False)
    message = F.concat(
        F.lit("app source "), "source_ip", F.lit(" used non-app credential '"), credential, F.lit("'")
    )
    return calls.withColumns(
        {
            "caller_class": F.when(by_source & by_credential, "app")
            .when(by_source, "suspicious")
            .otherwise("admin"),
            "caller": F.when(by_source & ~by_credential, message)
            .when(~by_source & by_credential, F.concat(F.lit("stolen:"), credential))
            .otherwise(credential),
        }
    )


def subject_binding(requests: DataFrame) -> DataFrame:
    """Audit a request log: 200 where the token may read the path, else 403.

    ``requests``: endpoint (user or deployment), path_user, token_audience, token_subject.
    """
    own = (F.col("token_audience") == "user") & (F.col("token_subject") == F.col("path_user"))
    allowed = F.when(F.col("endpoint") == "user", own).otherwise(F.col("token_audience") == "admin")
    return requests.withColumn("status", F.when(allowed, 200).otherwise(403))


def egress_decisions(
    log: DataFrame, allowlist: DataFrame, mode: str, version: int, default_ports: tuple[int, ...] = (443,)
) -> DataFrame:
    """Outbound calls with the decision the given enforcement mode makes.

    ``allowlist``: domain (exact host), ports, purpose; one row per domain.
    """
    listed = allowlist.select(
        F.col("domain").alias("destination"),
        F.coalesce("ports", F.array(*[F.lit(p) for p in default_ports])).alias("__ports"),
        F.col("purpose").alias("__purpose"),
    )
    joined = log.join(listed, "destination", "left")
    on_list = F.coalesce(F.array_contains("__ports", F.col("port")), F.lit(False))
    allowed = {"dev": F.lit(True), "locked": F.lit(False), "allowlisted": on_list}[mode]
    return joined.select(
        *log.columns,
        allowed.alias("allowed"),
        F.lit(mode).alias("enforcement_mode"),
        F.lit(version).alias("allowlist_version"),
        F.when(on_list, F.col("__purpose")).alias("purpose"),
    )
