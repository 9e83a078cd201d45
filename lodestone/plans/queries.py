"""The library's operators applied to the driver's tables, each with SQL that gives the same rows.

Roles: predictions are line items, pipelines orders, runs customers; array rows are embeddings, JSON cells the events'
properties, files documents and pages, metadata labels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import kept
from ..functions import values as v
from ..operators import lowering, run_manifests, store, verify
from ..operators import relational as rel
from ..operators.detect import detect_tree, kind_of_path, kinds
from ..operators.dispatch import plans
from ..operators.folding import folded_digest
from ..operators.trees import tree_changes, tree_nodes
from ..schemas import ENGINE, KINDS, NATIVE, PRESERVABLE
from ..schemas import TABLES as TABLES_OF_STORE
from ..sources.parquet_store import footers

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return register


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def chain_summary(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rel.with_children(t.orders.select("o_orderkey", "o_custkey"), customers, "o_custkey", t.lineitem, "l_orderkey", "o_orderkey").select("o_orderkey", "c_name")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def missing_rows(t: Tables) -> DataFrame:
    return rel.missing(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_checksums(t: Tables) -> DataFrame:
    return rel.missing(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("select doc_id from documents where doc_id % 10 = 0 and sha256(text) <> sha256(lower(text))")
def mismatched_rows(t: Tables) -> DataFrame:
    text = F.col("text")
    before = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    after = t.documents.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.lower(text)).otherwise(text), 256).alias("digest"))
    return rel.mismatched(before, after, ["doc_id"], "digest")


@query("""select coalesce(b.k, a.k) o_orderkey, case when b.k is null then 'added' when a.k is null then 'removed' else 'changed' end change
  from (select o_orderkey k, o_totalprice p from orders where o_orderkey % 7 <> 0) b
  full join (select o_orderkey k, case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end p from orders where o_orderkey % 11 <> 0) a on a.k = b.k
  where a.p is distinct from b.p""")
def snapshot_diff(t: Tables) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    before = t.orders.where(key % 7 != 0).select("o_orderkey", "o_totalprice")
    after = t.orders.where(key % 11 != 0).select("o_orderkey", F.when(key % 13 == 0, price + 1).otherwise(price).alias("o_totalprice"))
    return rel.snapshot_diff(before, after, "o_orderkey", "o_totalprice")


@query("select page_id from pages where page_id % 3 = 0 and not url like '%/contract.json'")
def orphan_files(t: Tables) -> DataFrame:
    ledger = t.pages.where("page_id % 3 <> 0").select("page_id")
    return rel.missing(t.pages.where(~F.col("url").endswith("/contract.json")).select("page_id"), ledger, ["page_id"])


@query("""with p as (select regexp_split_to_array(regexp_replace(url, '^https?://', ''), '[/?]') a from pages),
  q as (select unnest(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[1:i], '/'))) path from p)
  select path, count(*) n from q group by 1""")
def prefix_payload(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?", "/")
    return t.pages.select(F.explode(v.ancestors(path)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("select d.doc_id, coalesce(quality, -1) quality, coalesce(nullif(lang, ''), 'unknown') lang from documents d left join labels l using (doc_id)")
def metadata_lookup(t: Tables) -> DataFrame:
    found = rel.lookup_last(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "quality", ["quality"])
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), v.or_default(F.col("lang"), "unknown").alias("lang"))


@query("select source, sha256(string_agg(sha256(text), ',' order by doc_id)) fingerprint from documents group by source")
def tree_fingerprint(t: Tables) -> DataFrame:
    return folded_digest(t.documents.select("source", "doc_id", "text"), ["source"], ["doc_id"], F.sha2("text", 256), between=",", prefix="").withColumnRenamed("digest", "fingerprint")


@query("""select lang, 'sha256:' || sha256('{' || string_agg('"' || doc_id || '":"' || sha256(text) || '"', ',' order by doc_id::varchar) || '}') digest from documents group by lang""")
def directory_digest(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("path"), F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("digest"))
    return verify.folder_digests(rows).select(F.col("path").alias("lang"), "digest")


@query("select user_id, arg_min(value, event_id) first_value, arg_max(event_type, event_id) last_type from events group by 1")
def first_seen_last_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("event_type", "event_id").alias("last_type"))


@query("select l_orderkey, l_linenumber, count(*) - 1 extra from lineitem group by all having count(*) > 1")
def duplicate_rows(t: Tables) -> DataFrame:
    return rel.extra_occurrences(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, branch, count(*) n from (select l_orderkey, case when l_linenumber > 2 then l_linenumber end branch from lineitem) where branch is not null group by all having count(*) > 1")
def natural_key_violations(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("branch"))
    return rel.key_violations(rows, ["l_orderkey", "branch"])


@query("select o_orderkey from orders where o_custkey % 5 = 0")
def orphan_references(t: Tables) -> DataFrame:
    return rel.orphan_references(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_custkey % 5 <> 0"), "c_custkey").select("o_orderkey")


@query("select lang, string_agg(distinct source, ',' order by source) sources from documents group by 1")
def distinct_sorted_list(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(" union all ".join(f"select '{x}' name, count(*) n from {x}" for x in TABLES))
def table_counts(t: Tables) -> DataFrame:
    return reduce(DataFrame.union, (getattr(t, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in TABLES))


@query("select case when event_type = 'error' then 'refused' when value < 50 then 'preserved' else 'lowered' end disposition, count(*) n from events group by 1")
def disposition_counts(t: Tables) -> DataFrame:
    disposition = F.when(F.col("event_type") == "error", "refused").when(F.col("value") < 50, "preserved").otherwise("lowered")
    return t.events.groupBy(disposition.alias("disposition")).agg(F.count("*").alias("n"))


@query("select vec_id, len(embedding) n, list_max(embedding)::double m from embeddings")
def array_shape(t: Tables) -> DataFrame:
    shape = F.array(F.size("embedding"))
    return t.embeddings.select("vec_id", v.sample_count(F.col("embedding"), shape).cast("long").alias("n"), F.array_max("embedding").cast("double").alias("m"))


@query("select vec_id, generate_subscripts(embedding, 1)::int - 1 pos, unnest(embedding) item from embeddings")
def array_flatten_explode(t: Tables) -> DataFrame:
    part = lambda a, n: F.slice("embedding", a, n)
    cell = F.to_json(F.array(F.array(part(1, 8), part(9, 8)), F.array(F.slice("embedding", 17, 1 << 30))))
    return t.embeddings.select("vec_id", F.posexplode(v.decode_array(cell)).alias("pos", "item")).withColumn("item", F.col("item").cast("float"))


@query("select conv_id, count(role) n, max(turn) + 1 m, count(role) = max(turn) + 1 agree from conversations group by 1")
def length_agreement(t: Tables) -> DataFrame:
    got = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"), (F.max("turn") + 1).alias("m"))
    agree = v.lengths_agree(F.col("roles"), F.sequence(F.lit(1).cast("long"), F.col("m")))
    return got.select("conv_id", F.size("roles").cast("long").alias("n"), "m", agree.alias("agree"))


@query("select event_id, case when event_id % 200 = 0 then 'y_true' else 'y_pred' end field from events where event_id % 100 = 0")
def nonfinite_fields(t: Tables) -> DataFrame:
    planted = F.when(F.col("event_id") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    first = F.when(F.col("event_id") % 200 == 0, planted).otherwise(F.lit(1.0))
    found = t.events.select("event_id", v.nonfinite_field(y_true=F.array(first), y_pred=F.array(F.lit(0.0), planted)).alias("field"))
    return found.where("field is not null")


@query("select event_id, (props->>'$.k')::bigint k from events")
def json_cell_decode(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("[["), F.get_json_object("props", "$.k"), F.lit("]]"))
    return t.events.select("event_id", F.get(v.decode_array(cell, "bigint"), 0).alias("k"))


@query(r"""select page_id, trim(regexp_replace(url, '[/\\:*?"<>|\s.]+', '_', 'g'), '_') name from pages""")
def sanitize_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", v.file_name(F.col("url")).alias("name"))


@query("""select event_id, 'chain-' || sha256('["' || event_type || '","' || user_id || '"]')[1:24] id from events""")
def stable_id(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.stable_id("chain", F.col("event_type"), F.col("user_id").cast("string")).alias("id"))


@query("""select event_id, 'sha256:' || sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || value || '}') digest from events""")
def row_checksum(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.digest(v.canonical_json(F.col("event_id"), F.col("event_type"), F.col("value"))).alias("digest"))


@query(r"select p_partkey, [regexp_extract(p_brand, '(\d+)', 1)::int, p_size] > [10, 25] forward from part")
def version_compare(t: Tables) -> DataFrame:
    text = F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size").cast("string"), F.lit("x"))
    return t.part.select("p_partkey", (v.version(text) > F.array(F.lit(10), F.lit(25)).cast("array<decimal(38,0)>")).alias("forward"))


@query("select d.doc_id, coalesce(nullif(case when quality = 1 then '' else quality::varchar end, ''), nullif(source, ''), 'none') said from documents d left join labels l using (doc_id)")
def first_nonempty(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    quality = F.when(F.col("quality") == 1, "").otherwise(F.col("quality").cast("string"))
    return found.select("doc_id", v.first_filled(quality, F.col("source"), default="none").alias("said"))


@query(r"""select page_id, case when x = 'store.sqlite' then 'sqlite-workspace-v2' when regexp_matches(x, '^runs/[^/]+/[^/]+/manifest\.yaml$') then 'fs-runs-legacy' when regexp_matches(x, '^[^/]+\.n4a\.py$') then 'n4a-py-bundle'
  when regexp_matches(x, '^[^/]+\.n4a$') then 'n4a-bundle' end kind from (select page_id, case page_id % 5 when 0 then 'store.sqlite' when 1 then 'runs/' || regexp_replace(url, '^https?://', '') || '/manifest.yaml' when 2 then page_id || '.n4a.py' when 3 then page_id || '.n4a' else url end x from pages)""")
def classify_kind(t: Tables) -> DataFrame:
    n = F.col("page_id").cast("string")
    names = F.array(F.lit("store.sqlite"), F.concat(F.lit("runs/"), F.regexp_replace("url", "^https?://", ""), F.lit("/manifest.yaml")), F.concat(n, F.lit(".n4a.py")), F.concat(n, F.lit(".n4a")), F.col("url"))
    return t.pages.select("page_id", kind_of_path(F.get(names, (F.col("page_id") % 5).cast("int"))).alias("kind"))


@query("select c_custkey::bigint run_id, c_name as name, null::varchar config, 'running' as status, c_acctbal::double score from customer")
def column_intersection(t: Tables) -> DataFrame:
    source = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), "c_nationkey")
    target = T.StructType().add("run_id", T.LongType()).add("name", T.StringType()).add("config", T.StringType()).add("status", T.StringType()).add("score", T.DoubleType())
    return rel.project_onto(source, target, {"status": F.lit("running")})


@query("""select 'missing' as "check", count(*) failures from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
  union all select 'duplicates', coalesce(sum(n - 1), 0)::bigint from (select count(*) n from lineitem group by l_orderkey, l_linenumber)
  union all select 'orphans', count(*) from documents where doc_id not in (select doc_id from labels)""")
def verification_rollup(t: Tables) -> DataFrame:
    parts = {"missing": (missing_rows(t), F.count("*")), "duplicates": (duplicate_rows(t), F.coalesce(F.sum("extra"), F.lit(0))), "orphans": (missing_checksums(t), F.count("*"))}
    return reduce(DataFrame.union, (df.agg(n.cast("long").alias("failures")).select(F.lit(k).alias("check"), "failures") for k, (df, n) in parts.items()))


@query("select vec_id, round(sqrt(avg(d * d)), 6) rmse, round(max(abs(d)), 6) delta from (select vec_id, e - round(e, 2) d from (select vec_id, unnest(embedding)::double e from embeddings)) group by 1")
def rmse_maxdelta(t: Tables) -> DataFrame:
    off = F.transform("embedding", lambda x: x.cast("double") - F.round(x.cast("double"), 2))
    return t.embeddings.select("vec_id", F.round(v.rmse(off), 6).alias("rmse"), F.round(F.array_max(F.transform(off, F.abs)), 6).alias("delta"))


@query("select o_orderkey, c_name, n_name, l_linenumber from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey left join lineitem on l_orderkey = o_orderkey and l_linenumber = 1")
def store_inspection(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    return t.orders.join(customers, "o_custkey").join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "l_linenumber")


@query("select event_type, min(event_id) seq, arg_max(value, event_id) last_value from events group by 1")
def distinct_first_seen(t: Tables) -> DataFrame:
    seen = rel.distinct_first_seen(t.events, "event_type", "event_id")
    return seen.join(t.events.groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value")), "event_type")


@query("select lang, min(doc_id) doc_id, arg_min(source, doc_id) source, arg_min(n_chars, doc_id) n_chars from documents group by 1")
def first_row_of_group(t: Tables) -> DataFrame:
    return rel.first_by(t.documents, ["lang"], "doc_id", ["doc_id", "source", "n_chars"])


@query("""select k, arg_max(d, p) digest from (select doc_id k, sha256(text) d, 1 p from documents
  union all select doc_id, sha256(quality || ':' || toxic), 2 from labels) group by 1""")
def ledger_union(t: Tables) -> DataFrame:
    one = t.documents.select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("d"), F.lit(1).alias("p"))
    two = t.labels.select(F.col("doc_id").alias("k"), F.sha2(F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string")), 256).alias("d"), F.lit(2).alias("p"))
    return one.unionByName(two).groupBy("k").agg(F.max_by("d", "p").alias("digest"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: (round(x::double, 3) + 0.0)::varchar), ',') || ']' cell, len(embedding) n, false as bad from embeddings")
def array_cell_roundtrip(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("decimal(10,3)").cast("double").cast("string")), ","), F.lit("]"))
    rows = t.embeddings.select("vec_id", v.canonical_text(cell).alias("cell"))
    found = v.decode_array(F.col("cell"))
    return rows.select("vec_id", "cell", F.size(found).cast("long").alias("n"), v.decode_failed(F.col("cell"), found).alias("bad"))


# ---- the operators of detection, lowering and checks, on sources made of the driver's tables ------------------------------

_TREE = """select 'root-' || doc_id // 10 root, case doc_id % 10 when 0 then 'store.duckdb' when 1 then 'store.sqlite' when 2 then 'runs/r' || doc_id || '/run_manifest.yaml'
  when 3 then 'runs/r/' || doc_id || '/manifest.yaml' when 4 then doc_id || '_predictions.json' when 5 then doc_id || '.n4a' when 6 then doc_id || '.n4a.py'
  when 7 then 'native/manifest.json' when 8 then 'native/score_set.json' else 'native/predictions.parquet' end rel_path from documents"""


@query(f"""select root, path, kind source_kind, string_agg(rel_path, ',' order by rel_path) files from (select root, rel_path,
  case when rel_path like 'runs/%' then 'runs' when rel_path like '%\\_predictions.json' escape '\\' then '.' when rel_path like 'native/%' then 'native' else rel_path end path,
  case when rel_path = 'store.duckdb' then 'duckdb-workspace' when rel_path = 'store.sqlite' then 'sqlite-workspace-v2' when rel_path like '%/run_manifest.yaml' then 'fs-runs-v2'
  when rel_path like 'runs/%' then 'fs-runs-legacy' when rel_path like '%\\_predictions.json' escape '\\' then 'loose-predictions' when rel_path like '%.n4a' then 'n4a-bundle'
  when rel_path like '%.n4a.py' then 'n4a-py-bundle' else 'native-results-v1' end kind from (select distinct * from ({_TREE}))) group by all having kind <> 'native-results-v1' or count(*) = 3""")
def detected_artifacts(t: Tables) -> DataFrame:
    n = F.col("doc_id").cast("string")
    names = [
        F.lit("store.duckdb"), F.lit("store.sqlite"), F.concat(F.lit("runs/r"), n, F.lit("/run_manifest.yaml")), F.concat(F.lit("runs/r/"), n, F.lit("/manifest.yaml")),
        F.concat(n, F.lit("_predictions.json")), F.concat(n, F.lit(".n4a")), F.concat(n, F.lit(".n4a.py")), F.lit("native/manifest.json"), F.lit("native/score_set.json"), F.lit("native/predictions.parquet"),
    ]
    tree = t.documents.select(F.concat(F.lit("root-"), F.expr("doc_id div 10").cast("string")).alias("root"), F.get(F.array(*names), (F.col("doc_id") % 10).cast("int")).alias("rel_path"))
    return detect_tree(tree).select("root", "path", "source_kind", F.array_join("files", ",").alias("files"))


def _cells(t: Tables) -> DataFrame:
    """Array rows of the embeddings as JSON cells: some are short by one, some hold NaN, some are no arrays."""
    cell = F.to_json("embedding")
    pred = F.when(F.col("vec_id") % 7 == 0, F.to_json(F.slice("embedding", 2, 1 << 30))).when(F.col("vec_id") % 11 == 0, F.regexp_replace(cell, r"\[[^,]+", "[NaN")).when(F.col("vec_id") % 13 == 0, F.lit("{}")).otherwise(cell)
    proba = F.to_json(F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2)))
    return t.embeddings.select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("prediction_id"), F.concat(F.lit("set/"), F.col("label").cast("string")).alias("dataset_name"),
        cell.alias("y_true"), pred.alias("y_pred"), proba.alias("y_proba"), F.lit(None).cast("string").alias("weights"),
    )


@query("""select 'p' || vec_id prediction_id, 'set/' || label dataset_name, len(embedding) n_true, 4::bigint n_proba, '2,2' proba_shape,
  case when vec_id % 7 = 0 then 'lengths_differ' when vec_id % 11 = 0 then 'not_finite' when vec_id % 13 = 0 then 'array_not_decoded' end violation from embeddings""")
def array_records(t: Tables) -> DataFrame:
    found = lowering.array_records(_cells(t))
    shape = F.array_join(F.col("y_proba_shape").cast("array<string>"), ",")
    return found.select("prediction_id", "dataset_name", F.size("y_true").cast("long").alias("n_true"), F.size("y_proba").cast("long").alias("n_proba"), shape.alias("proba_shape"), "violation")


def _loose_files(t: Tables) -> DataFrame:
    """A loose record for each order: some lack a field, have an empty one, differ in lengths, or are no objects."""
    n = F.col("o_orderkey")
    text = {c: F.concat(F.lit(f"{c[0]}-"), F.col(k).cast("string")) for c, k in (("run_id", "o_custkey"), ("pipeline_id", "o_orderkey"), ("prediction_id", "o_orderkey"))}
    fixed = {"dataset": F.col("o_orderpriority"), "model_name": F.lit("m"), "model_class": F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("M")), "fold_id": F.lit("0"), "partition": F.col("o_orderstatus"), "metric": F.lit("rmse"), "task_type": F.lit("regression")}
    arrays = {"sample_indices": F.array(F.lit(1), F.lit(2)), "y_true": F.array(F.lit("1.5"), F.lit("2")), "y_pred": F.when(n % 7 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.5)))}
    extra = {"val_score": F.col("o_totalprice"), "preprocessing": F.array(F.lit("snv"), F.lit("scale"))}
    record = F.to_json(F.struct(*(c.alias(k) for k, c in (text | fixed | arrays | extra).items())))
    record = F.when(n % 11 == 0, F.lit("[1]")).when(n % 3 == 0, F.regexp_replace(record, '"fold_id":"0",', "")).otherwise(record)
    return t.orders.select(F.concat(n.cast("string"), F.lit("_predictions.json")).alias("prediction_file"), record.alias("text"))


_LOOSE = "case when o_orderkey % 11 = 0 then 'not_an_object' when o_orderkey % 3 = 0 then 'field_missing' when o_orderkey % 5 = 0 then 'text_empty_or_of_other_type' when o_orderkey % 7 = 0 then 'lengths_differ' end"


@query(f"select o_orderkey || '_predictions.json' prediction_file, case when {_LOOSE} = 'not_an_object' then null else 'r-' || o_custkey end run_id, {_LOOSE} violation from orders")
def loose_records(t: Tables) -> DataFrame:
    return lowering.loose_rows(_loose_files(t)).select("prediction_file", "run_id", "violation")


@query(f"""select 'chain-' || sha256('["r-' || o_custkey || '","p-' || o_orderkey || '","M","m"]')[1:24] chain_id, 'p-' || o_orderkey pipeline_id, '["snv","scale","M"]' steps, 2::bigint model_step_idx, 'snv, scale' preprocessings,
  o_orderpriority dataset_name, 'per_fold' fold_strategy from orders where {_LOOSE} is null""")
def loose_chains(t: Tables) -> DataFrame:
    chains = lowering.lower_loose(lowering.loose_rows(_loose_files(t)), "now").tables["chains"]
    return chains.select("chain_id", "pipeline_id", "steps", "model_step_idx", "preprocessings", "dataset_name", "fold_strategy")


@query(f"select 'r-' || o_custkey run_id, 'loose-predictions r-' || o_custkey as name, 'completed' status from orders where {_LOOSE} is null group by all")
def loose_runs(t: Tables) -> DataFrame:
    return lowering.lower_loose(lowering.loose_rows(_loose_files(t)), "now").tables["runs"].select("run_id", "name", "status")


def _native(t: Tables, with_numbers: bool = True) -> lowering.Lowered:
    """Native results of the line items: a dataset for each flag, a configuration for each line number; runs and records need no row numbers."""
    numbers, reals = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    text = {"dataset": F.col("l_returnflag"), "config_name": F.concat(F.lit("c"), F.col("l_linenumber").cast("string")), "model_name": F.lit("m"), "partition": F.col("l_linestatus"), "fold_id": F.col("l_orderkey").cast("string"), "refit_context": F.lit("")}
    columns = text | {
        "sample_indices": F.array("l_partkey", "l_suppkey"), "y_true": F.array("l_quantity", "l_tax"), "y_pred": F.array("l_quantity", "l_discount"), "y_proba": reals, "weights": reals, "y_proba_shape": numbers,
        "y_true_shape": F.when(F.col("l_linenumber") == 7, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2))), "y_pred_shape": F.array(F.lit(2)), "arrays_present": F.col("l_linenumber") != 6, "val_score": F.col("l_extendedprice"),
    }
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = rel.numbered(t.lineitem, ["l_linenumber"], order, "number") if with_numbers else t.lineitem.withColumn("number", F.lit(0).cast("long"))
    rows = rows.withColumn("_row", F.col("number") * 10 + F.col("l_linenumber"))
    rows = rows.select("_row", *(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NATIVE))
    return lowering.lower_native(rows, {"run_id": "run", "engine": ENGINE, "schema_version": 3, "metric": "rmse", "task_type": ["regression"], "score_set_hash": "0"}, "now")


_ROWS = "(select *, row_number() over (partition by l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) * 10 + l_linenumber as r from lineitem)"


@query(f"""select 'prediction-' || sha256('["run",' || r || ',"' || l_returnflag || '","c' || l_linenumber || '","m","' || l_linestatus || '","' || l_orderkey || '",""]')[1:24] prediction_id,
  'pipeline-' || sha256('["run","' || l_returnflag || '","c' || l_linenumber || '"]')[1:24] pipeline_id, l_returnflag dataset_name, 2::bigint n_samples, 'rmse' metric, 'regression' task_type, l_extendedprice val_score from {_ROWS}""")
def native_predictions(t: Tables) -> DataFrame:
    return _native(t).tables["predictions"].select("prediction_id", "pipeline_id", "dataset_name", "n_samples", "metric", "task_type", "val_score")


@query(f"""select 'pipeline-' || sha256('["run","' || l_returnflag || '","c' || l_linenumber || '"]')[1:24] pipeline_id, 'c' || l_linenumber as name, arg_min(l_extendedprice, r) best_val from {_ROWS} group by l_returnflag, l_linenumber""")
def native_pipelines(t: Tables) -> DataFrame:
    return _native(t).tables["pipelines"].select("pipeline_id", "name", "best_val")


@query("select case when l_linenumber = 7 then 'rank_above_one' end violation, l_returnflag dataset_name, count(*) n, sum(case when l_linenumber = 7 then 0 else 2 end)::bigint n_indices from lineitem where l_linenumber <> 6 group by 1, 2")
def native_records(t: Tables) -> DataFrame:
    records = _native(t, with_numbers=False).records
    return records.groupBy("violation", "dataset_name").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.array_size("sample_indices"), F.lit(0))).cast("long").alias("n_indices"))


def _store(t: Tables) -> dict[str, DataFrame]:
    """Store tables of orders and line items; references to customers that are not there, and repeated keys, stay in."""
    runs = t.customer.where("c_acctbal >= 0").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("run_id"), F.col("c_name").alias("name"))
    pipelines = t.orders.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("pipeline_id"), F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run_id"), F.lit("x").alias("name"), F.col("o_orderpriority").alias("dataset_name"), F.col("o_orderstatus").alias("status"))
    chains = t.lineitem.select(F.concat_ws("-", F.lit("c"), "l_orderkey", "l_linenumber").alias("chain_id"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("pipeline_id"), F.lit("[]").alias("steps"), F.col("l_linenumber").alias("model_step_idx"), F.col("l_shipmode" if "l_shipmode" in t.lineitem.columns else "l_returnflag").alias("model_class"))
    # written, as each rule reads it again
    chains = kept(chains.repartition(t.lineitem.count() // rel.TASK_ROWS + 1, "chain_id").dropDuplicates(["chain_id"]))
    made = {"runs": runs, "pipelines": pipelines, "chains": chains}
    spark = t.spark
    return {name: rel.project_onto(made[name], schema, lowering.default_columns(name, "now")) if name in made else spark.createDataFrame([], schema) for name, schema in TABLES_OF_STORE.items()}


@query("""select rule, n from (select 'pipelines: no runs of its run_id' as rule, count(*) n from orders left join (select * from customer where c_acctbal >= 0) on c_custkey = o_custkey where c_custkey is null
  union all select 'chains: no pipelines of its pipeline_id', count(*) from (select distinct l_orderkey, l_linenumber from lineitem) where l_orderkey not in (select o_orderkey from orders)) where n > 0""")
def store_violations(t: Tables) -> DataFrame:
    return store.violations(_store(t))


@query("select 'pipelines' as name, count(*) n from orders union all select 'runs', count(*) from customer where c_acctbal >= 0 union all select 'chains', count(distinct (l_orderkey, l_linenumber)) from lineitem union all select x, 0 from (values ('projects'), ('predictions'), ('artifacts'), ('logs')) v(x)")
def store_counts(t: Tables) -> DataFrame:
    return store.count_rows(_store(t))


def _ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(preserved, files): a folder of documents for each source, some entries repeated, outside or with another checksum."""
    key = F.concat_ws("/", F.lit("preserved/kind"), "source", F.col("doc_id").cast("string"))
    files = t.documents.select(key.alias("key"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("digest"))
    folders = t.documents.groupBy("source").agg(F.min("doc_id").alias("seq"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("d"))))).alias("m"))
    path = F.concat(F.lit("preserved/kind/"), F.col("source"))
    right = v.digest(v.canonical_map(F.col("m")))
    checksum = F.when(F.col("source").endswith("3"), F.lit("sha256:0")).otherwise(right)
    good = folders.select("seq", F.when(F.col("source").endswith("5"), F.concat(F.lit("elsewhere/"), F.col("source"))).otherwise(path).alias("path"), checksum.alias("checksum"))
    again = folders.where(F.col("source").endswith("7")).select((F.col("seq") + 1_000_000_000).alias("seq"), path.alias("path"), right.alias("checksum"))
    none = folders.where(F.col("source").endswith("9")).select((F.col("seq") + 2_000_000_000).alias("seq"), F.concat(path, F.lit("-none")).alias("path"), right.alias("checksum"))
    return good.union(again).union(none), files


@query("""select distinct case right(source, 1) when '3' then 'mismatched_payloads' when '5' then 'outside_preserved' when '7' then 'duplicate_paths' else 'missing_checksums' end finding,
  case right(source, 1) when '5' then 'elsewhere/' || source when '9' then 'preserved/kind/' || source || '-none' else 'preserved/kind/' || source end path from documents where right(source, 1) in ('3', '5', '7', '9')""")
def preserved_findings(t: Tables) -> DataFrame:
    return verify.preserved_findings(*_ledger(t)).select("finding", "path")


@query("""select 'missing_rows' finding, 'p' || doc_id prediction_id from labels where doc_id not in (select vec_id from embeddings)
  union all select 'missing_row_checksums', 'p' || vec_id from embeddings where vec_id not in (select doc_id from labels)
  union all select 'mismatched_rows', 'p' || vec_id from embeddings join labels on doc_id = vec_id where label <> quality
  union all select 'orphan_rows', 'p' || vec_id from embeddings where vec_id not in (select doc_id from documents)""")
def array_findings(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("prediction_id")
    expected = t.labels.select(name("doc_id"), F.col("quality").cast("string").alias("digest"))
    actual = t.embeddings.select(name("vec_id"), F.col("label").cast("string").alias("digest"))
    return verify.array_findings(expected, actual, t.documents.select(name("doc_id")))


@query("""select event_id, '{"k":' || (props->>'$.k') || '}' as text from events""")
def canonical_texts(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.canonical_text(F.concat(F.lit(" "), "props", F.lit(" "))).alias("text"))


@query("select kind source_kind, min(event_id)::bigint seq, arg_max(version, event_id) detected_version from (select event_id, event_type kind, user_id::varchar as version from events) group by 1")
def kinds_seen(t: Tables) -> DataFrame:
    return kinds(t.events.select(F.col("event_type").alias("source_kind"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("detected_version")))


# ---- files, arrays of any depth, plans and manifests of many sources -------------------------------------------------------


def _each(of: str) -> str:
    """SQL that has a row for each column of each table: (name, column, what of says about it)."""
    return " union all ".join(f"select '{t}' as name, c as \"column\", n from (unpivot (select {of} as '\\1' from {t}) on columns(*) into name c value n)" for t in TABLES)


def _footers(t: Tables) -> DataFrame:
    said = footers(t.spark, *(f"{t.sf_dir}/{x}.parquet" for x in TABLES))
    return said.withColumn("table", F.regexp_extract("file", r"([^/]+)\.parquet(?:/[^/]*)?$", 1))


@query(f"""select r.name, r."column", r.n as n_rows, case when r."column" = 'embedding' then null else r.n - v.n end nulls from ({_each("count(*) + 0 * count(columns('(.*)'))")}) r join ({_each("count(columns('(.*)'))")}) v using (name, "column")""")
def footer_statistics(t: Tables) -> DataFrame:
    return _footers(t).groupBy(F.col("table").alias("name"), "column").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("nulls"))


@query(f"""select 'other_type' finding, table_name as "table", column_name as "column" from information_schema.columns where table_name in ({', '.join(f"'{x}'" for x in TABLES)}) and table_name <> 'pages' and data_type <> 'VARCHAR'
  union all select 'null_in_required', r.name, r."column" from ({_each("count(*) + 0 * count(columns('(.*)'))")}) r join ({_each("count(columns('(.*)'))")}) v using (name, "column") where r.n > v.n and r.name <> 'pages'
  union all select 'unknown_column', 'pages', column_name from information_schema.columns where table_name = 'pages'
  union all select 'missing_table', 'archive', null union all select 'other_version', null, null""")
def store_files(t: Tables) -> DataFrame:
    """The tables' files held against a schema that has all columns as required texts, lacks pages, and has one table more."""
    rows = [(x, c, "string", True) for x in TABLES if x != "pages" for c in getattr(t, x).columns] + [("archive", "id", "string", True)]
    expected = t.spark.createDataFrame(rows, "table string, column string, type string, required boolean")
    versions = t.region.agg(F.max("r_regionkey").cast("long").alias("user_version"))
    return store.file_findings(_footers(t), versions, expected).select("finding", "table", "column").distinct()


@query("""select doc_id, doc_id % 12 + 1 + (case when doc_id % 3 = 0 then 2 else 0 end) n, doc_id % 5 = 4 bad, array_to_string(list_concat(case when doc_id % 3 = 0 then [3] else [1] end, list_transform(range(doc_id % 20), lambda x: 1), [doc_id % 12 + 1]), ',') shape from documents""")
def deep_arrays(t: Tables) -> DataFrame:
    """Cells nested to 21 levels, a third of them with items of other depths beside the nested list."""
    n, depth = (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 20).cast("int")
    items = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when((F.col("doc_id") % 5 == 4) & (i == 1), F.lit("null")).otherwise(i.cast("string"))), ",")
    inner = F.concat(F.repeat(F.lit("["), depth), F.lit("["), items, F.lit("]"), F.repeat(F.lit("]"), depth))
    cell = F.concat(F.lit("["), inner, F.when(F.col("doc_id") % 3 == 0, F.lit(", 7, [[8], []]")).otherwise(F.lit("")), F.lit("]"))
    rows = t.documents.select("doc_id", cell.alias("cell"))
    found = v.decode_array(F.col("cell"))
    return rows.select("doc_id", F.size(found).cast("long").alias("n"), v.decode_failed(F.col("cell"), found).alias("bad"), F.array_join(v.array_shape(F.col("cell")).cast("array<string>"), ",").alias("shape"))


_ARTIFACTS = f"""select case when doc_id % 3 = 0 then 'one-' || doc_id else 'pair-' || doc_id // 3 end root, doc_id seq, source path, [{', '.join(f"'{k}'" for k in KINDS)}][(doc_id * 7 + n_chars) % {len(KINDS)} + 1] kind, doc_id % 11 = 0 newer from documents"""


@query(f"""with a as ({_ARTIFACTS}), c as (select *, count(*) over w n, count(*) filter (where kind <> 'unknown') over w known, bool_or(newer) over w newest, min(seq) filter (where kind = 'sqlite-workspace-legacy-arrays') over w store,
    count(*) filter (where kind = 'fs-runs-legacy') over w runs, count(*) filter (where kind not in ('fs-runs-legacy', 'loose-predictions')) over w others from a window w as (partition by root)),
  p as (select *, case when known = 0 then 'nothing_known' when newest then 'newer_version' end refusal, case when known = 0 or newest then 'refuse' when store is not null then 'store' when n = 1 and kind = 'native-results-v1' then 'native'
    when runs = 1 and others = 0 then 'run' when n = 1 and kind = 'loose-predictions' then 'loose' else 'keep' end plan from c),
  m as (select *, plan = 'store' and seq = store or plan in ('native', 'loose') or plan = 'run' and kind = 'fs-runs-legacy' main from p),
  d as (select *, case when plan = 'refuse' then 'refused' when main or plan = 'run' then 'lowered' when kind in ({', '.join(f"'{k}'" for k in PRESERVABLE)}) then 'preserved' else 'ignored' end disposition from m)
  select root, seq, plan, refusal, main, disposition, bool_or(disposition in ('preserved', 'refused')) over (partition by root) strict_refused from d""")
def migration_plans(t: Tables) -> DataFrame:
    root = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("one-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("pair-"), F.expr("doc_id div 3").cast("string")))
    kind = F.get(F.array(*map(F.lit, KINDS)), ((F.col("doc_id") * 7 + F.col("n_chars")) % len(KINDS)).cast("int"))
    artifacts = t.documents.select(root.alias("root"), F.col("doc_id").alias("seq"), F.col("source").alias("path"), kind.alias("source_kind"), (F.col("doc_id") % 11 == 0).alias("forward_version"))
    return plans(artifacts).select("root", "seq", "plan", "refusal", "main", "disposition", "strict_refused")


@query("""with d as (select *, regexp_extract(text, '[A-Za-z]+') w from documents)
  select doc_id::varchar as name, case when doc_id % 13 = 0 then 'again' else doc_id::varchar end run_id, lang dataset, case when doc_id % 7 <> 0 then w end model, case when doc_id % 7 <> 0 then '../' || source || '_predictions.json' end file,
  case when doc_id % 4 = 0 then '' else 'snv,' || w end steps, case when doc_id % 9 = 0 then 13 + case when doc_id % 13 = 0 then 1 else 0 end end bad_line from d""")
def manifest_tables(t: Tables) -> DataFrame:
    """A run manifest for each document: some say a scalar twice, leave sections out, have an empty list, or a line that is refused.

    Comments stand where a document lacks a value; without a doc_id no remainder applies to it.
    """
    n, word = F.col("doc_id"), F.regexp_extract("text", "[A-Za-z]+", 0)
    joined = lambda lines: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    some = lambda when, *lines: F.when(when, joined(lines)).otherwise(F.lit(""))
    said = lambda *lines: F.coalesce(joined(lines), F.lit("# none\n" * sum(x.count("\n") for x in lines if isinstance(x, str))))
    full = F.coalesce(n % 7 != 0, F.lit(False))
    text = F.concat(
        F.lit("# a run\n\n"), said("run_id: '", n.cast("string"), "'\r\n"), some(n % 13 == 0, "run_id: again\n"), said("dataset:   '", F.col("lang"), "'  \n"),
        some(full, "model:\n  class: M\n", said("  name: \"", word, "\"\n"), "predictions:\n", said("  file: ../", F.col("source"), "_predictions.json\n")), some(~full, "engine: a\n# none\n\n\n\n"),
        some(n % 4 == 0, "preprocessing:\n\n\n"), F.when(n % 4 == 0, "").otherwise(said("preprocessing:\n  - snv\n  - '", word, "'\n")), some(n % 9 == 0, "    deep: 1\n"),
    )
    found = run_manifests.manifests(t.documents.select(n.cast("string").alias("name"), text.alias("text")))
    return found.select("name", F.col("fields.run_id").alias("run_id"), F.col("fields.dataset").alias("dataset"), F.col("model.name").alias("model"), F.col("predictions.file").alias("file"), F.array_join("preprocessing", ",").alias("steps"), F.col("bad_line").cast("long").alias("bad_line"))


_FILES = "select source || '/' || lang || '/' || doc_id path, sha256(text) digest, doc_id, source, lang from documents"


@query(f"""with f as ({_FILES}), a as (select path, source, lang, digest from f where doc_id % 103 <> 5), b as (select path, source, lang, case when source like '%3' and doc_id % 29 = 0 then 'x' else digest end digest from f where doc_id % 101 <> 7),
  both_ as (select coalesce(a.path, b.path) path, coalesce(a.source, b.source) source, coalesce(a.lang, b.lang) lang, a.digest o, b.digest n from a full join b on a.path = b.path),
  l as (select source || '/' || lang path, source, count(o) o, count(n) n, bool_or(o is distinct from n) d from both_ group by source, lang), s as (select source path, count(o) o, count(n) n, bool_or(o is distinct from n) d from both_ group by source),
  lc as (select l.* from l join s on s.path = l.source where s.d), fc as (select both_.* from both_ join lc on lc.path = both_.source || '/' || both_.lang where lc.d),
  r as (select '' path, 0 as depth, 'dir' kind, 'changed' change, 1 compared from s having bool_or(d) union all
    select path, 1, 'dir', case when o = 0 then 'added' when n = 0 then 'removed' else 'changed' end, (select count(*) from s) from s where d union all
    select path, 2, 'dir', case when o = 0 then 'added' when n = 0 then 'removed' else 'changed' end, (select count(*) from lc) from lc where d union all
    select path, 3, 'file', case when o is null then 'added' when n is null then 'removed' else 'changed' end, (select count(*) from fc) from fc where o is distinct from n) select * from r""")
def changed_paths(t: Tables) -> DataFrame:
    """The documents as a tree of sources and languages: some files are added, removed or changed."""
    files = t.documents.select("doc_id", "source", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"))
    edited = F.when(F.col("source").endswith("3") & (F.col("doc_id") % 29 == 0), F.lit("x")).otherwise(F.col("digest"))
    return tree_changes(tree_nodes(files.where("doc_id % 103 <> 5")), tree_nodes(files.where("doc_id % 101 <> 7").withColumn("digest", edited)))


@query("""select 'run' run_id, 'native-results run' as name, '[' || string_agg('"' || f || '"', ',' order by f) || ']' datasets, 'completed' status, '{"engine":"dag-ml","schema_version":3}' config from (select distinct l_returnflag f from lineitem)""")
def native_runs(t: Tables) -> DataFrame:
    return _native(t, with_numbers=False).tables["runs"].select("run_id", "name", "datasets", "status", "config")


@query(f"""select 'p-' || o_orderkey prediction_id, 'p-' || o_orderkey pipeline_id, 'chain-' || sha256('["r-' || o_custkey || '","p-' || o_orderkey || '","M","m"]')[1:24] chain_id, o_orderstatus "partition", o_totalprice val_score, 2::bigint n_samples,
  '{{}}' scores, 'loose-predictions' prediction_scope from orders where {_LOOSE} is null""")
def loose_predictions(t: Tables) -> DataFrame:
    found = lowering.lower_loose(lowering.loose_rows(_loose_files(t)), "now").tables["predictions"]
    return found.select("prediction_id", "pipeline_id", "chain_id", "partition", "val_score", "n_samples", "scores", "prediction_scope")


@query("select doc_id, 'sha256:' || sha256(text) digest from documents")
def digest_prefixes(t: Tables) -> DataFrame:
    """Digests of which every second has its prefix already."""
    bare = F.sha2("text", 256)
    return t.documents.select("doc_id", v.prefixed(F.when(F.col("doc_id") % 2 == 0, v.digest(F.col("text"))).otherwise(bare)).alias("digest"))


@query("""select event_id, case event_id % 6 when 0 then value when 1 then event_id::double when 2 then (event_id % 4 = 2)::int::double when 3 then 'nan'::double when 4 then '-inf'::double end n, case when event_id % 3 > 0 then event_id % 3 end size from events""")
def scalar_casts(t: Tables) -> DataFrame:
    """Texts of numbers, Booleans, words for what is not finite, and others; lists that may be empty."""
    n = F.col("event_id")
    text = F.get(F.array(F.col("value").cast("string"), F.concat(F.lit(" "), n.cast("string")), F.when(n % 4 == 2, "true").otherwise("false"), F.lit("NaN"), F.lit("-Infinity"), F.lit("12d")), (n % 6).cast("int"))
    items = F.slice(F.array(n, n), F.lit(1), F.greatest(n % 3, F.lit(0)).cast("int"))  # none below zero
    return t.events.select("event_id", v.number(text).alias("n"), F.array_size(v.null_if_empty(items)).cast("long").alias("size"))
