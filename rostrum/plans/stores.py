"""Queries over what a run leaves behind: cached embeddings, scores that grow by batches, counters. With their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import entities, ranking, requirements
from rostrum.operators.counters import Counters
from rostrum.plans import fixtures as X
from rostrum.plans.catalogue import CTE, KEPT, R3, REPEATED, _repeated, _skilled, _three, query
from rostrum.sources.cache import embedded_through
from rostrum.sources.external import HashEmbedder
from rostrum.sources.io import scratch_folder, settled
from rostrum.sources.versions import Versions
from rostrum.streaming.incremental import scale_new_records


class _Counted(HashEmbedder):
    def __init__(self, calls):
        super().__init__(16)
        self.calls = calls

    def embed(self, texts):
        self.calls.add(1)
        return super().embed(texts)


@query("embedding_cache", """select doc_id, sha256('hashed||' || text) as key, text is not null as embedded, case when text is not null then 16 else 0 end::int as size, 0::bigint as second_calls from {documents}""")
def embedding_cache(s, d):
    """Every document's vector, twice through one cache: the second run calls the embedder for nothing."""
    docs, calls = X.table(s, d, "documents").select("doc_id", "text"), s.sparkContext.accumulator(0)
    cache, model = Versions(s, scratch_folder(s)), _Counted(calls)
    embedded_through(docs, model, cache, "hashed")
    before = calls.value
    out = embedded_through(docs, model, cache, "hashed")
    return out.select("doc_id", F.sha2(F.concat(F.lit("hashed||"), "text"), 256).alias("key"), F.col("vec").isNotNull().alias("embedded"), F.coalesce(F.array_size("vec"), F.lit(0)).alias("size"), F.lit(calls.value - before).cast("long").alias("second_calls"))


@query("incremental_scores", f"""with r as (select c_custkey, cast(c_acctbal as double) as raw from {{customer}}), b as (select min(raw) lo, max(raw) hi from r)
select c_custkey, raw, {R3.format('(raw - lo) / (hi - lo)')} as score from r, b""")
def incremental_scores(s, d):
    """Scores that arrive in three folders, each a run of the stream of its own; old ones are scaled anew where the bounds move."""
    rows = X.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("raw"))
    at = scratch_folder(s)
    for k in range(3):
        rows.where(F.col("c_custkey") % 3 == k).write.mode("append").parquet(f"{at}/in")
        scale_new_records(s, f"{at}/in", rows.schema, f"{at}/scores", f"{at}/state", lambda df: df, "c_custkey", "raw", "score").awaitTermination()
    return Versions(s, f"{at}/scores").read("scaled")


def counted_run(people, specs: dict, score):
    """(ranking, counters) of one run: repeated records go, then those that miss a requirement; ``score`` makes final_score and years of the rest.

    processed: records read; errors: those with neither id nor name, which are left out; duplicates, filtered and ranked. Nothing is read again for them."""
    counts, nobody = Counters(), entities.entity_key().isNull()
    people = counts.watch(people, processed=F.count(F.lit(1)), errors=F.count_if(nobody))
    first = counts.watch(entities.keep_first(people.where(~nobody), "ord"), first=F.count(F.lit(1)))
    kept, _ = requirements.mandatory(first, specs)
    kept = settled(counts.watch(kept, kept=F.count(F.lit(1))))
    rows = settled(counts.watch(score(kept).where("final_score is not null"), ranked=F.count(F.lit(1))))
    out = ranking.ranked(rows, F.col("final_score"), F.col("years").desc(), F.col("candidate_id").asc())
    n = counts.values()
    return out, {"processed": n["processed"], "errors": n["errors"], "duplicates": n["processed"] - n["errors"] - n["first"], "filtered": n["first"] - n["kept"], "ranked": n["ranked"]}


@query("pipeline_counters", f"""{KEPT}, {REPEATED[len(CTE) + 2:]},
e as (select * from dup where not (ord like '%7a' and src = 1)), firsts as (select candidate_id, name from e qualify case when candidate_id is not null then row_number() over (partition by candidate_id order by ord) = 1 else row_number() over (partition by name order by ord) = 1 end),
ok as (select f.candidate_id from firsts f join checked c using (candidate_id) where ok)
select (select count(*) from dup) as processed, (select count(*) from dup where ord like '%7a' and src = 1) as errors, (select count(*) from e) - (select count(*) from firsts) as duplicates,
(select count(*) from firsts) - (select count(*) from ok) as filtered, (select count(*) from fin join ok using (candidate_id) where final_score is not null) as ranked""")
def pipeline_counters(s, d):
    gone = (F.col("src") == 1) & F.col("candidate_id").like("%7")
    rows = _repeated(s, d).withColumn("nobody", gone).join(_skilled(s, d).drop("name"), "candidate_id", "left")
    rows = rows.withColumns({"candidate_id": F.when(~F.coalesce("nobody", F.lit(False)), F.col("candidate_id")), "name": F.when(~F.coalesce("nobody", F.lit(False)), F.col("name"))})
    _, n = counted_run(rows, X.MANDATORY, lambda kept: _three(s, d, kept.select("candidate_id", "name", "years_experience", "skills")))
    return s.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n))
