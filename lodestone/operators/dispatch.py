"""What becomes of each artifact of many sources: one plan for each root from the counts of its kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PRESERVABLE

STORE, NATIVE, RUN, LOOSE = "sqlite-workspace-legacy-arrays", "native-results-v1", "fs-runs-legacy", "loose-predictions"


def plans(artifacts: DataFrame) -> DataFrame:
    """artifacts (root, seq, path, source_kind, forward_version) with plan, refusal, main, disposition and strict_refused.

    plan, by root, the first that applies: refuse, if nothing is known or an artifact is newer than supported (refusal says
    which); store, if there is a store with legacy arrays; native or loose, if that is the only artifact; run, if there is one
    legacy run beside loose predictions or nothing; keep. main marks the artifact that is lowered; of the others, those of a run belong to it
    and the rest is preserved or, where that is not done for its kind, ignored. strict_refused: a strict run would refuse the root.

    Roots are counted by partial sums and joined back, so a root of any number of artifacts is no single task's.
    """
    kind = F.col("source_kind")
    n = lambda what: F.coalesce(F.sum(F.when(what, 1).otherwise(0)), F.lit(0))
    counted = artifacts.groupBy("root").agg(
        n(F.lit(True)).alias("n"), n(kind != "unknown").alias("known"), n(F.coalesce("forward_version", F.lit(False))).alias("newer"), F.min(F.when(kind == STORE, F.col("seq"))).alias("first_store"),
        n(kind == NATIVE).alias("native"), n(kind == RUN).alias("runs"), n(kind == LOOSE).alias("loose"), n(~kind.isin(RUN, LOOSE)).alias("others"),
    )
    refusal = F.when(F.col("known") == 0, "nothing_known").when(F.col("newer") > 0, "newer_version")
    plan = (
        F.when(refusal.isNotNull(), "refuse")
        .when(F.col("first_store").isNotNull(), "store")
        .when((F.col("n") == 1) & (F.col("native") == 1), "native")
        .when((F.col("runs") == 1) & (F.col("others") == 0), "run")
        .when((F.col("n") == 1) & (F.col("loose") == 1), "loose")
        .otherwise("keep")
    )
    counted = counted.select(F.col("root").alias("__root"), "first_store", plan.alias("plan"), refusal.alias("refusal"))
    rows = artifacts.join(counted, F.col("root").eqNullSafe(F.col("__root")))
    main = (F.col("plan") == "store") & (kind == STORE) & (F.col("seq") == F.col("first_store")) | F.col("plan").isin("native", "loose") | (F.col("plan") == "run") & (kind == RUN)
    disposition = F.when(F.col("plan") == "refuse", "refused").when(main | (F.col("plan") == "run"), "lowered").when(kind.isin(PRESERVABLE), "preserved").otherwise("ignored")
    rows = rows.select(*artifacts.columns, "plan", "refusal", F.coalesce(main, F.lit(False)).alias("main"), disposition.alias("disposition"))
    kept = rows.where("disposition in ('preserved', 'refused')").select(F.col("root").alias("__root")).distinct().withColumn("strict_refused", F.lit(True))
    rows = rows.join(kept, F.col("root").eqNullSafe(F.col("__root")), "left").drop("__root")
    return rows.withColumn("strict_refused", F.coalesce("strict_refused", F.lit(False)))
