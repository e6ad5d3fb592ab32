"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from histomesh.llm import centroids, decontaminate, langid, licenses, linedup, merkle, neardup, packing, pii, quality, topk, toxicity, warc
from histomesh.llm.sample import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def packing_sql(source: str = "documents", buckets: int = 8, align: int = 64, budget: int = 16384) -> str:
    """The dynamic programme unrolled, one table per number of buckets."""
    steps = ["c0 as (select 0 as j, 0 as cost)"]
    for k in range(1, buckets + 1):
        steps.append(
            f"""s{k} as (select t.j, p.j as i, p.cost + (t.upto - coalesce(q.upto, 0)) * t.length as cost from t join c{k - 1} p on p.j < t.j left join t q on q.j = p.j),
 c{k} as (select j, min(cost) as cost, arg_min(i, (cost, i)) as i from s{k} group by j)"""
        )
    back = [f"b{buckets} as (select least({buckets}, n) as k, n as j from (select max(j) as n from t))"]
    for k in range(buckets, 0, -1):
        back.append(f"b{k - 1} as (select case when b.k >= {k} then {k - 1} else b.k end as k, case when b.k >= {k} then c.i else b.j end as j from b{k} b left join c{k} c on c.j = b.j)")
    ends = " union all ".join(f"select j from b{k} where k = {k}" for k in range(1, buckets + 1))
    return f"""with d as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from {source}),
 a as (select *, greatest(1, cast(ceil(n_tokens / {align}.0) as bigint)) * {align} as padded from d),
 t as (select padded as length, row_number() over (order by padded) as j, sum(count(*)) over (order by padded) as upto from a group by padded),
 {", ".join(steps)}, {", ".join(back)}, e as ({ends}),
 k as (select row_number() over (order by t.length) - 1 as bucket, t.length as bucket_length from e join t on t.j = e.j),
 p as (select a.doc_id, a.n_tokens, min_by(k.bucket, k.bucket_length) as bucket, min(k.bucket_length) as bucket_length from a join k on k.bucket_length >= a.padded group by 1, 2),
 r as (select *, row_number() over (partition by bucket order by doc_id) - 1 as place, greatest(1, {budget} // bucket_length) as per_batch from p)
 select doc_id, n_tokens, bucket, bucket_length, place // per_batch as batch, place % per_batch as slot from r"""


@_query("op1_packing", packing_sql())
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.word_count(F.col("text")))


_BASE32 = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5), lambda k: cast(substr(bits, cast(1 + 5 * i + k as int), 1) as int) * cast(power(2, 4 - k) as int))) as int), 1)), 'string_agg', '')"


@_query(
    "op2_warc",
    f"""with p as (select page_id, coalesce(html, '') as html from pages),
 b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
   1 + 4 * (instr('0123456789abcdef', substr(sha1(html), cast(i as int), 1)) - 1), 4)), 'string_agg', '') as bits from p),
 d as (select page_id, strlen(html) as payload_bytes, {_BASE32} as payload_digest, max(page_id) over (partition by html) as head from b)
 select page_id, payload_bytes, payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type,
   case when page_id = head then null else head end as refers_to from d""",
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, folder = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_bundles(frames, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query(
    "op4_topk",
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vec from embeddings
   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.vec, c.vec) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
 select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    models = langid.fit(docs, ~held_out)
    found = langid.predict(docs.drop("lang"), models, reject=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@_query(
    "op6_linedup",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as body, unnest(range(0, len(string_split(text, chr(10))))) as line from documents where text is not null),
 w as (select *, list_filter(list_distinct(regexp_split_to_array(lower(body), '[\\x20\\x09\\x0B\\x0C\\x0D]+')), lambda x: x <> '') as ws from l),
 s as (select body, min((doc_id, line)) as place, any_value(ws) as ws from w where len(ws) >= 5 group by body),
 f as (select word, count(*) as n from (select unnest(ws) as word from s) group by 1),
 o as (select s.body, s.place, len(s.ws) as n, u.word, row_number() over (partition by s.body order by f.n, u.word) as pos from s, unnest(s.ws) u(word) join f on f.word = u.word),
 p as (select * from o where pos <= n - cast(ceil(n * 4 / 5.0) as int) + 1),
 c as (select distinct a.body as later, b.body as earlier from p a join p b on a.word = b.word and b.place < a.place and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
 g as (select distinct c.later from c join s x on x.body = c.later join s y on y.body = c.earlier
   where 5 * len(list_intersect(x.ws, y.ws)) >= 4 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
 x as (select body, min((doc_id, line)) as place from w where len(ws) between 1 and 4 and len(body) >= 20 group by body),
 e as (select w.doc_id, w.line from w join s on s.body = w.body where s.place <> (w.doc_id, w.line) or w.body in (select later from g)
   union all select w.doc_id, w.line from w join x on x.body = w.body where x.place <> (w.doc_id, w.line)),
 r as (select doc_id, count(*) as n_removed, list(line order by line) as removed from e group by 1)
 select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(r.n_removed, 0) as n_removed,
   coalesce(r.removed, []) as removed from documents d left join r on r.doc_id = d.doc_id""",
)
def op6_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(_table(spark, sf_dir, "documents"))


@_query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query(
    "op8_neardup",
    """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
 s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then ws
     else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as shingle from w),
 n as (select doc_id, count(*) as n from s group by 1),
 sets as (select min(doc_id) as rep, max(n) as n, list(doc_id) as docs from (select doc_id, count(*) as n, list(shingle order by shingle) as body from s group by 1) group by body),
 t as (select s.doc_id, s.shingle from s join sets on s.doc_id = sets.rep),
 inter as (select x.doc_id as a, y.doc_id as b, count(*) as common from t x join t y on x.shingle = y.shingle and x.doc_id < y.doc_id
   join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id where 100 * least(nx.n, ny.n) >= 80 * greatest(nx.n, ny.n) group by 1, 2),
 links as (select a, b from inter join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
 e as (select a, b from links union all select b, a from links),
 r as (select rep as node, rep as seen from sets union select r.node, e.b from r join e on e.a = r.seen),
 c as (select node, min(seen) as component from r group by 1),
 m as (select unnest(docs) as doc_id, component from sets join c on c.node = sets.rep)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component, d.doc_id) as component_id, coalesce(m.component, d.doc_id) = d.doc_id as kept
 from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id""",
)
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, threshold=80)


@_query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), "toxic", ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", "offending"
    )


def merkle_sql(inner: int = 7, outer: int = 4) -> str:
    """Every level as a table; enough levels for 8 ** inner documents of a language and 8 ** outer languages."""
    crc = (
        "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, len(cast(doc_id as varchar)) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), cast(i as int), 1)) as bigint))),"
        " lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, cast(3988292384 as bigint) * (c & 1)))))"
    )
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"d as (select doc_id, coalesce('1' || lang, '0') as tree, {leaf('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {leaf(low)} else {leaf('text')} end as told from documents)",
        "l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from d)",
        "a0 as (select tree, pos, leaf as h, count(*) over (partition by tree) as n from l)",
    ]

    def climb(table: str, steps: int) -> None:
        for k in range(steps):
            out.append(f"{table}r{k} as (select tree, pos // 8 as run, list(h order by pos) as hs, max(n) as n from {table}{k} group by 1, 2)")
            out.append(f"{table}{k + 1} as (select tree, run as pos, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h, cast(ceil(n / 8.0) as bigint) as n from {table}r{k})")

    climb("a", inner)
    out.append(f"b0 as (select '' as tree, row_number() over (order by tree) - 1 as pos, h, count(*) over () as n, tree as own from a{inner})")
    climb("b", outer)
    out.append(f"p0 as (select l.*, s.h as subroot, r.h as root, s.pos as spot, '' as proof, l.told as folded from l join b0 s on s.own = l.tree cross join b{outer} r)")
    step = 0
    for table, place, tree, steps in (("a", "pos", "p.tree", inner), ("b", "spot", "''", outer)):
        for k in range(steps):
            at = f"((p.{place} // {8**k}) % 8)"
            before, after = f"coalesce(array_to_string(r.hs[1:{at}], ''), '')", f"coalesce(array_to_string(r.hs[{at} + 2:], ''), '')"
            out.append(
                f"p{step + 1} as (select p.* exclude (proof, folded), case when r.n = 1 then p.proof else p.proof || {before} || {after} end as proof,"
                f" case when r.n = 1 then p.folded else sha256({before} || p.folded || {after}) end as folded from p{step} p join {table}r{k} r on r.tree = {tree} and r.run = p.{place} // {8 ** (k + 1)})"
            )
            step += 1
    return f"with {', '.join(out)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from p{step}"


@_query("op11_merkle", merkle_sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = merkle.leaf_digest(*[merkle.lowered(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS])
    told = F.coalesce(F.when(chosen, tampered), F.lit(""))
    proved = merkle.manifest(_table(spark, sf_dir, "documents"), carry={"told": told})
    start = F.when(F.col("told") != "", F.col("told")).otherwise(F.col("leaf"))
    out = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(start, F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op12_licenses")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_table(spark, sf_dir, "documents"))


def centroids_sql(k: int = 8, rounds: int = 10, limit: int = 1 << 27) -> str:
    whole = f"cast(floor(least(greatest(1024 * cast(x as double), -{limit}), {limit})) as bigint)"
    apart = "cast(list_sum(list_transform(range(1, 65), lambda i: (v.v[cast(i as int)] - c.v[cast(i as int)]) * (v.v[cast(i as int)] - c.v[cast(i as int)]))) as hugeint)"
    out = [
        f"v as materialized (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: {whole}) as v from embeddings"
        " where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v from v order by c limit {k})",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} as materialized (select vec_id, r, any_value(vv) as v, arg_min(c, (d, c)) as c, min(d) as d from (select v.vec_id, v.r, v.v as vv, c.c, {apart} as d from v cross join c{i} c) group by 1, 2)")
        if i < rounds:
            out.append(f"s{i} as (select c, i, sum(v[cast(i as int)]) as s, count(*) as n from a{i}, range(1, 65) t(i) group by 1, 2)")
            out.append(
                f"c{i + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{i} c left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{i} group by 1) m on m.c = c.c)"
            )
    return f"""with {", ".join(out)}
 select a.vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
   sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.c = a.c"""


@_query("op13_centroids", centroids_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


QUERIES["pipeline"] = corpus_pipeline.run
