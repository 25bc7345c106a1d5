"""Alert construction: group, deduplicate, cool down, rate-limit.

The state machine of a key is sequential, so it is fed as little as possible:

* qualifying assessments of a key form *sessions* (gaps <= grouping window).  Once
  an alert is open it absorbs the rest of its session, and a session's first
  ``max(cooldown, limit window)`` is the only part in which an opening can still
  be refused.  Later rows of a session are therefore pre-aggregated by Spark.
* sessions further apart than every horizon are independent *islands*; they are
  spread over the cluster and folded in streaming batches with O(1) state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuthwatchError, DetectionConfig, micros
from ..functions.scalar import micros_of, uuid5
from ..operators.prefix import running, with_chunk
from ..runtime import cut_lineage
from ..schema import SCHEMA_VERSION, SECURITY_ALERTS, SEVERITIES
from .rules import CATEGORY_GROUP, lit
from .scoring import severity_rank

KEY = ["attack_category", "scope_kind", "scope_value"]
_FOLDED = (
    "row string, attack_category string, scope_kind string, scope_value string, first_us long, "
    "last_us long, events long, rules array<string>, risk_units long, peak double, initial int, "
    "current int, escalations long, suppressed long, reason string"
)


def gate(assessments: DataFrame, config: DetectionConfig) -> DataFrame:
    """Fired assessments with the floor that stops them, if any (``gate_reason``)."""
    a = config.alerting
    floor = SEVERITIES.index(a.min_alert_severity)
    return assessments.where("fired_rule_count > 0").selectExpr(
        "*",
        f"CASE WHEN risk_score < {lit(float(a.min_alert_risk_score))} THEN 'below_score_floor' "
        f"WHEN {severity_rank('severity')} < {floor} THEN 'below_severity_floor' END AS gate_reason")


def keyed(gated: DataFrame, scope: DataFrame | None, config: DetectionConfig) -> DataFrame:
    """Qualifying assessments with their grouping key and mode."""
    rows = gated.where("gate_reason IS NULL").select(
        "anchor_event_id", micros_of(F.col("anchor_event_time")).alias("us"),
        F.col("primary_attack_category").alias("attack_category"), "risk_score",
        F.expr(severity_rank("severity")).alias("rank"), F.col("fired_rule_ids").alias("rules"))
    if scope is None:
        return rows.selectExpr("*", "'none' AS scope_kind", "'' AS scope_value", "false AS scope_missing")
    dims = {c: config.alerting.scope_dimension[g] for c, g in CATEGORY_GROUP.items()}
    kind = "CASE attack_category {} END".format(" ".join(f"WHEN '{c}' THEN '{d}'" for c, d in dims.items()))
    rows = rows.join(scope.select("anchor_event_id", "user_scope", "source_scope"), "anchor_event_id", "left")
    rows = rows.selectExpr("*", f"{kind} AS wanted_kind")
    rows = rows.selectExpr(
        "*", "CASE wanted_kind WHEN 'user' THEN user_scope WHEN 'source' THEN source_scope END AS found")
    return rows.selectExpr(
        "anchor_event_id", "us", "attack_category", "risk_score", "rank", "rules",
        "CASE WHEN found IS NULL THEN 'none' ELSE wanted_kind END AS scope_kind",
        "coalesce(found, '') AS scope_value", "found IS NULL AS scope_missing")


def fold_input(rows: DataFrame, config: DetectionConfig) -> DataFrame:
    """Session heads row by row, session tails as one aggregate, tagged with their island."""
    a = config.alerting
    grouping, cooldown, limit = micros(a.grouping_window), micros(a.cooldown), micros(a.alert_limit_window)
    rows = rows.selectExpr(
        "anchor_event_id AS id", "us", *KEY, "risk_score", f"cast(round(risk_score * {10 ** config.scoring.round_decimals}) as bigint) AS risk_units",
        "rank", "rules")
    rows = with_chunk(rows, "us", max(grouping, cooldown, limit))
    rows = running(rows, KEY, "us", {"prev_us": ("max", "us")})
    rows = rows.selectExpr(
        "*", f"prev_us IS NULL OR us - prev_us > {grouping}L AS opens_session",
        f"prev_us IS NULL OR us - prev_us > {max(grouping, cooldown, limit)}L AS opens_island")
    rows = running(rows, KEY, "us", {
        "session_before": ("max", "CASE WHEN opens_session THEN us END"),
        "island_before": ("max", "CASE WHEN opens_island THEN us END"),
    })
    rows = rows.selectExpr(
        *KEY, "id", "us", "risk_score", "risk_units", "rank", "rules",
        "CASE WHEN opens_session THEN us ELSE session_before END AS session_us",
        "CASE WHEN opens_island THEN us ELSE island_before END AS island_us")
    horizon = max(cooldown, limit)
    head = rows.where(f"us <= session_us + {horizon}L").selectExpr(
        *KEY, "island_us", "us", "id", "1L AS events", "risk_units", "risk_score AS peak", "us AS last_us",
        "rules", "rank AS first_rank", "cast(array() as array<int>) AS ranks")
    tail = rows.where(f"us > session_us + {horizon}L")
    # The order in which severities first appear decides how often the tail escalates.
    firsts = [F.min(F.when(F.col("rank") == r, F.struct("us", "id", "rank"))) for r in range(len(SEVERITIES))]
    tail = tail.groupBy(*KEY, "island_us", "session_us").agg(
        F.min(F.struct("us", "id", "rank")).alias("first"), F.count("*").alias("events"),
        F.sum("risk_units").alias("risk_units"), F.max("risk_score").alias("peak"), F.max("us").alias("last_us"),
        F.collect_set(F.concat_ws(",", "rules")).alias("rule_sets"),
        *[f.alias(f"s{r}") for r, f in enumerate(firsts)],
    ).selectExpr(
        *KEY, "island_us", "first.us AS us", "first.id AS id", "events", "risk_units", "peak", "last_us",
        "array_distinct(flatten(transform(rule_sets, s -> split(s, ',')))) AS rules",
        "first.rank AS first_rank",
        "transform(array_sort(array_compact(array({}))), s -> s.rank) AS ranks".format(
            ", ".join(f"s{r}" for r in range(len(SEVERITIES)))))
    return head.unionByName(tail)


def _folder(grouping: int, cooldown: int, limit_window: int, limit: int, bypass: bool):
    """The sequential state machine over rows sorted by (key, island, time, id)."""

    def fold(batches):
        import pandas as pd

        names = ["row", *KEY, "first_us", "last_us", "events", "rules", "risk_units", "peak", "initial",
                 "current", "escalations", "suppressed", "reason"]
        island, alert, closed, slot = None, None, None, None
        counts: dict[str, int] = {}
        out: list[tuple] = []

        def emit(a):
            out.append(("alert", *island[:3], a["first"], a["last"], a["n"], sorted(a["rules"]), a["sum"],
                        a["peak"], a["initial"], a["current"], a["esc"], a["sup"], None))

        def finish():
            if closed is not None:
                emit(closed)
            if alert is not None:
                emit(alert)
            for reason, n in counts.items():
                out.append(("suppressed", *island[:3], None, None, n, [], None, None, None, None, None, None, reason))

        for batch in batches:
            for r in batch.itertuples(index=False):
                here = (r.attack_category, r.scope_kind, r.scope_value, r.island_us)
                if here != island:
                    if island is not None:
                        finish()
                    island, alert, closed, slot, counts = here, None, None, None, {}
                ranks = [int(x) for x in r.ranks] or [int(r.first_rank)]
                if alert is not None and r.us - alert["last"] > grouping:
                    if closed is not None:
                        emit(closed)
                    closed, alert = alert, None
                if alert is None:
                    escalating = False
                    if closed is not None and r.us - closed["last"] <= cooldown:
                        escalating = r.first_rank > closed["current"] or r.peak > closed["peak"]
                        if not (escalating and bypass):
                            closed["sup"] += 1
                            counts["cooldown"] = counts.get("cooldown", 0) + 1
                            continue
                    if slot is None or r.us - slot[0] > limit_window:
                        slot = (r.us, 1)
                    elif slot[1] >= limit:
                        if closed is not None:
                            closed["sup"] += 1
                        counts["rate_limit"] = counts.get("rate_limit", 0) + 1
                        continue
                    else:
                        slot = (slot[0], slot[1] + 1)
                    if escalating:
                        counts["escalated"] = counts.get("escalated", 0) + 1
                    alert = dict(first=r.us, last=r.us, n=0, rules=set(), sum=0, peak=0.0,
                                 initial=int(r.first_rank), current=int(r.first_rank), esc=0, sup=0)
                alert["n"] += int(r.events)
                alert["rules"].update(r.rules)
                alert["sum"] += int(r.risk_units)
                alert["peak"] = max(alert["peak"], float(r.peak))
                alert["last"] = max(alert["last"], int(r.last_us))
                for rank in ranks:
                    if rank > alert["current"]:
                        alert["current"], alert["esc"] = rank, alert["esc"] + 1
                        counts["escalated"] = counts.get("escalated", 0) + 1
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        if island is not None:
            finish()
        if out:
            yield pd.DataFrame(out, columns=names)

    return fold


def fold(rows: DataFrame, config: DetectionConfig) -> DataFrame:
    a = config.alerting
    spread = [*KEY, "island_us"]
    ordered = fold_input(rows, config).repartition(*spread).sortWithinPartitions(*spread, "us", "id")
    return ordered.mapInPandas(
        _folder(micros(a.grouping_window), micros(a.cooldown), micros(a.alert_limit_window),
                a.max_alerts_per_group_per_window, a.escalation_bypasses_cooldown),
        _FOLDED)


class AlertRun:
    """Alert tables of one run over stored assessments: ``alerts``, ``suppressed`` and ``accounting``."""

    def __init__(self, assessments: DataFrame, scope: DataFrame | None = None,
                 config: DetectionConfig | None = None):
        self.config = config or DetectionConfig()
        self.gated = gate(assessments, self.config)
        # Qualifying assessments are read several times below; they are stored once
        # instead of recomputing the detection pipeline for every pass.
        self.keyed = cut_lineage(keyed(self.gated, scope, self.config))
        if scope is not None and self.config.alerting.strict_scope:
            if not self.keyed.where("scope_missing").isEmpty():
                raise AuthwatchError("strict scope: a required scope dimension is missing")
        self.folded = cut_lineage(fold(self.keyed, self.config))

    @property
    def alerts(self) -> DataFrame:
        group = "CASE attack_category {} END".format(
            " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in CATEGORY_GROUP.items()))
        names = "element_at(array({}), {{}} + 1)".format(", ".join(f"'{s}'" for s in SEVERITIES))
        digits = self.config.scoring.round_decimals
        rows = self.folded.where("row = 'alert'").selectExpr(
            f"'{SCHEMA_VERSION}' AS detection_schema_version", "attack_category",
            f"{group} AS correlation_group",
            "CASE scope_kind WHEN 'none' THEN 'category_scoped' ELSE 'entity_scoped' END AS grouping_mode",
            "scope_kind", "CASE scope_kind WHEN 'none' THEN NULL ELSE scope_value END AS scope_value",
            "first_us", "timestamp_micros(first_us) AS first_seen", "timestamp_micros(last_us) AS last_seen",
            "events AS contributing_event_count", "rules AS contributing_rule_ids",
            # exact decimals, so that a mean halfway between two scores goes to the even one
            f"least(cast(bround(cast(risk_units as decimal(20,0)) / cast(events as decimal(20,0)), 0) as double) / {10 ** digits}D, peak)"
            " AS aggregate_risk_score",
            "peak AS peak_risk_score", f"{names.format('initial')} AS initial_severity",
            f"{names.format('current')} AS current_severity", "escalations AS escalation_count",
            "suppressed AS suppressed_event_count")
        name = F.concat_ws("|", F.lit(SCHEMA_VERSION), "attack_category", "correlation_group", "scope_kind",
                           F.coalesce("scope_value", F.lit("")), F.col("first_us").cast("string"))
        rows = rows.withColumn("alert_id", uuid5(self.config.id_namespace + "/alert", name))
        return rows.select(*SECURITY_ALERTS.names)

    @property
    def suppressed(self) -> DataFrame:
        """(reason, attack_category, events): floors and state-machine refusals."""
        floors = self.gated.where("gate_reason IS NOT NULL").groupBy(
            F.col("gate_reason").alias("reason"), F.col("primary_attack_category").alias("attack_category")
        ).agg(F.count("*").alias("events"))
        refused = self.folded.where("row = 'suppressed' AND reason != 'escalated'").groupBy(
            "reason", "attack_category").agg(F.sum("events").alias("events"))
        return floors.unionByName(refused)

    @property
    def accounting(self) -> DataFrame:
        """One row; ``qualifying = grouped + cooldown + rate_limit`` always holds."""
        folded = self.folded.agg(
            F.count_if(F.col("row") == "alert").alias("alert_count"),
            F.coalesce(F.sum(F.when(F.col("row") == "alert", F.col("events"))), F.lit(0)).alias("grouped"),
            *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("events"))), F.lit(0)).alias(r)
              for r in ("cooldown", "rate_limit", "escalated")],
            F.count_if((F.col("row") == "alert") & (F.col("scope_kind") != "none")).alias("entity_scoped"),
        )
        gates = self.gated.agg(
            F.count_if(F.col("gate_reason").isNull()).alias("qualifying"),
            F.count_if(F.col("gate_reason") == "below_score_floor").alias("below_score_floor"),
            F.count_if(F.col("gate_reason") == "below_severity_floor").alias("below_severity_floor"),
        )
        # Two single-row aggregates side by side.
        return gates.join(F.broadcast(folded))


def check_scope(scope: DataFrame, assessments: DataFrame) -> None:
    """The scope table must hold exactly one row per assessed anchor."""
    twice = scope.groupBy("anchor_event_id").count().where("count > 1").count()
    if twice:
        raise AuthwatchError(f"the entity-scope table repeats {twice} anchor(s)")
    sides = scope.select("anchor_event_id", F.lit(1).alias("s")).join(
        assessments.select("anchor_event_id", F.lit(1).alias("a")), "anchor_event_id", "full_outer"
    ).agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra")).first()
    if sides.missing or sides.extra:
        raise AuthwatchError(f"scope mismatch: {sides.missing} anchor(s) without scope, {sides.extra} extra")


def rule_agreement(assessments: DataFrame, detections: DataFrame) -> DataFrame:
    """Anchors whose fired rule ids differ between the two tables (empty when they agree)."""
    listed = detections.groupBy("anchor_event_id").agg(F.array_sort(F.collect_set("rule_id")).alias("found"))
    fired = assessments.where("fired_rule_count > 0").select("anchor_event_id", "fired_rule_ids")
    return fired.join(listed, "anchor_event_id", "full_outer").where(
        ~F.col("fired_rule_ids").eqNullSafe(F.col("found")))
