"""Hybrid retrieval, its evaluation, and the embedding job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.governance import cosine
from lorekeep.functions.text import tokens
from lorekeep.operators import embedding, evaluation, hybrid, inverted, lexical, semantic, vector_index
from lorekeep.operators.joins import attach, sized_join
from lorekeep.session import staged
from lorekeep.sources import files
from lorekeep.testbed.registry import SQL_VIEWS, Context, query, six

_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{_SPACE}'), lambda t: t <> '')"


def _bm25_views(prefix: str, docs: str) -> dict[str, str]:
    """BM25 of every (question, document) pair over ``docs``, by joining postings - the plain
    formula, fit for a small corpus only."""
    p = prefix
    return {
        f"{p}_docs": f"select knowledge_id, {_tokens(chr(39).join(['title||', ' ', '||summary']))} toks from {docs}",
        f"{p}_post": f"""
            select knowledge_id, len(toks) n, unnest(toks) term from {p}_docs""",
        f"{p}_tf": f"select knowledge_id, term, n, count(*) f from {p}_post group by all",
        f"{p}_df": f"select term, count(*) df from {p}_tf group by term",
        f"{p}_size": f"select count(*) docs, avg(len(toks)) mean from {p}_docs",
        f"{p}_plain": f"select term, df, ln(docs - df + 0.5) - ln(df + 0.5) w from {p}_df, {p}_size",
        f"{p}_idf": f"""
            select term, df, case when w < 0 then 0.25 * (select avg(w) from {p}_plain) else w end idf from {p}_plain""",
        f"{p}_asked": f"select query_id, unnest({_tokens('question')}) term from b_questions",
        f"{p}_hits": f"""
            select a.query_id, t.knowledge_id,
              sum(i.idf * t.f * 2.5 / (t.f + 1.5 * (1 - 0.75 + 0.75 * t.n / z.mean))) score
            from {p}_asked a join {p}_idf i on a.term = i.term join {p}_tf t on t.term = a.term, {p}_size z
            group by all""",
        f"{p}_scores": f"""
            select q.query_id, d.knowledge_id, round(coalesce(h.score, 0.0), 9) score
            from b_questions q cross join {p}_docs d
            left join {p}_hits h on h.query_id = q.query_id and h.knowledge_id = d.knowledge_id""",
        f"{p}_top": f"""
            select * from (select *, row_number() over (partition by query_id order by score desc, knowledge_id) rank
              from {p}_scores) where rank <= 10""",
    }


def _norm(view: str) -> str:
    return f"""
        select query_id, knowledge_id, rank, case when hi = lo then 1.0 else (score - lo) / (hi - lo) end score
        from (select *, min(score) over (partition by query_id) lo, max(score) over (partition by query_id) hi from {view})"""


def _hashed_views() -> dict[str, str]:
    """The stand-in embedding: signed word counts at the CRC-32 of a word, without their length."""
    def sums(key: str, text: str, view: str) -> str:
        return f"""
            select {key}, slot, sum(sign) v from (select {key}, unnest({_tokens(text)}) w from {view}) t
            join x_slots using (w) group by {key}, slot"""

    return {
        "x_table": """
            select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
              lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tbl""",
        "x_words": f"""
            select distinct unnest({_tokens('summary')}) w from v_eligible
            union select distinct unnest({_tokens('question')}) from b_questions""",
        "x_crc": """
            select w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2),
                lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)::bigint)),
              lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) h
            from (select w, hex(encode(w)) x from x_words), x_table""",
        "x_slots": "select w, h % 64 slot, case when h & 65536 = 0 then -1 else 1 end sign from x_crc",
        "x_docs": sums("knowledge_id", "summary", "v_eligible"),
        "x_asked": sums("query_id", "question", "b_questions"),
        "x_doc_lengths": "select knowledge_id, sqrt(sum(v * v)) n from x_docs group by knowledge_id",
        "x_asked_lengths": "select query_id, sqrt(sum(v * v)) n from x_asked group by query_id",
        "x_dots": """
            select query_id, knowledge_id, sum(a.v * d.v) dot from x_asked a join x_docs d on a.slot = d.slot group by all""",
        "x_scores": """
            select q.query_id, k.knowledge_id, round(coalesce(dot / (a.n * l.n), 0.0), 9) score
            from b_questions q cross join v_eligible k
            left join x_dots d on d.query_id = q.query_id and d.knowledge_id = k.knowledge_id
            left join x_asked_lengths a on a.query_id = q.query_id left join x_doc_lengths l on l.knowledge_id = k.knowledge_id""",
    }


SQL_VIEWS.update(_hashed_views())
SQL_VIEWS.update(_bm25_views("l", "v_eligible"))
SQL_VIEWS.update(_bm25_views("w", "w_topic"))
SQL_VIEWS.update({
    "w_topic": "select * from v_eligible where topic_id = '42'",
    "s_scores": """
        select q.query_id, e.knowledge_id, e.topic_id, round(coalesce(list_cosine_similarity(
          cast(q.embedding as double[]), cast(e.embedding as double[])), 0.0), 9) score
        from b_questions q cross join b_embeddings e""",
    "s_top": """
        select * from (select *, row_number() over (partition by query_id order by score desc, knowledge_id) rank
          from s_scores) where rank <= 10""",
    "n_sem": _norm("s_top"),
    "n_lex": _norm("l_top"),
    "h_merged": """
        select coalesce(s.query_id, l.query_id) query_id, coalesce(s.knowledge_id, l.knowledge_id) knowledge_id,
          coalesce(s.score, 0.0) semantic_score, coalesce(l.score, 0.0) lexical_score,
          round(0.6 * coalesce(s.score, 0.0) + 0.4 * coalesce(l.score, 0.0), 9) hybrid_score
        from n_sem s full join n_lex l on s.query_id = l.query_id and s.knowledge_id = l.knowledge_id""",
    "h_ranked": """
        select *, row_number() over (partition by query_id order by hybrid_score desc, knowledge_id) rank from h_merged""",
    "h_live": "select * from h_ranked where rank <= 10 and knowledge_id in (select knowledge_id from v_eligible)",
    "h_search": """
        select * from (select * replace (row_number() over (partition by query_id order by rank) as rank) from h_live)
        where rank <= 5""",
    # Labelled cases: a question expects its own document and the first that contains it whole.
    "e_within": """
        select 'q_'||cast(b.item_id as varchar) query_id, min('know_'||cast(d.doc_id as varchar)) knowledge_id
        from benchmark b join documents d on contains(lower(d.text), lower(b.text)) group by 1""",
    "e_expected": """
        select query_id, knowledge_id from e_within
        union select query_id, replace(query_id, 'q_', 'know_') from b_questions""",
    "e_cases": """
        select q.query_id id, q.question, case when q.query_id in (select query_id from e_within) then 'lexical'
            else 'semantic' end style,
          case when k.review_status = 'APPROVED' then 'grounded' else 'governance_reject' end type,
          case when k.review_status <> 'APPROVED' then k.knowledge_id end excluded_knowledge_id
        from b_questions q join b_k1 k on k.knowledge_id = replace(q.query_id, 'q_', 'know_')""",
    "e_lists": """
        select query_id, 'semantic' method, knowledge_id, rank from s_top
        union all select query_id, 'lexical', knowledge_id, rank from l_top
        union all select query_id, 'hybrid', knowledge_id, rank from h_ranked where rank <= 10""",
    "e_governed": """
        select *, row_number() over (partition by query_id, method order by rank) again from e_lists
        where knowledge_id in (select knowledge_id from v_eligible)""",
    "e_results": """
        select c.id, c.type, c.style,
          coalesce(bool_or(g.method='semantic' and g.again<=5 and x.knowledge_id is not null), false) semantic_hit,
          coalesce(bool_or(g.method='lexical' and g.again<=5 and x.knowledge_id is not null), false) lexical_hit,
          coalesce(bool_or(g.method='hybrid' and g.again<=5 and x.knowledge_id is not null), false) hybrid_hit,
          count(*) filter (g.method='semantic') = 0 semantic_empty,
          count(*) filter (g.method='lexical') = 0 lexical_empty,
          count(*) filter (g.method='hybrid') = 0 hybrid_empty,
          case when c.type='governance_reject' then exists (select 1 from e_lists r where r.query_id=c.id and
            r.method='hybrid' and r.rank<=5 and r.knowledge_id=c.excluded_knowledge_id) end excluded_id_was_a_raw_candidate,
          case when c.type='governance_reject' then not coalesce(bool_or(g.method='hybrid' and g.again<=5
            and g.knowledge_id=c.excluded_knowledge_id), false) end excluded_id_correctly_dropped
        from e_cases c left join e_governed g on g.query_id = c.id
        left join e_expected x on x.query_id = c.id and x.knowledge_id = g.knowledge_id
        group by c.id, c.type, c.style, c.excluded_knowledge_id""",
})


# ---- vectors and terms -------------------------------------------------------------------------

_SEMANTIC = "select query_id, knowledge_id, rank, round(score, 6) score from s_top"
_LEXICAL = "select query_id, knowledge_id, rank, round(score, 6) score from l_top"


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "knowledge_id", "rank", six("score"))


@query("topk_semantic", _SEMANTIC)
def topk_semantic(c: Context) -> DataFrame:
    return _out(semantic.cosine_top(c.questions, c.embeddings))


@query("topk_semantic_index", _SEMANTIC)
def topk_semantic_index(c: Context) -> DataFrame:
    """The same rows from the stored clusters."""
    return _out(vector_index.cosine_top(c.questions, c.vector_index))


@query("vector_index_clusters", """
    select count(*) vectors, true inside from b_embeddings where embedding is not null""")
def vector_index_clusters(c: Context) -> DataFrame:
    """Every vector is in one cluster and no further from its centre than the cluster's radius."""
    members = c.vector_index.blocks.select("cluster", F.explode("embeddings").alias("v"))
    placed = members.join(F.broadcast(c.vector_index.clusters), "cluster")
    inside = F.acos(F.least(F.lit(1.0), cosine(F.col("v").cast("array<double>"), F.col("centre")))) <= F.col("radius") + 1e-6
    return placed.agg(F.count(F.lit(1)).alias("vectors"), F.bool_and(inside | (F.col("cluster") < 0)).alias("inside"))


@query("semantic_search", """
    select s.query_id, s.knowledge_id, s.rank, round(s.score, 6) score, e.topic_id, e.title, e.summary
    from s_top s join b_embeddings e on s.knowledge_id = e.knowledge_id""")
def semantic_search(c: Context) -> DataFrame:
    found = semantic.semantic_search(c.questions, files.embedding_corpus(c.embeddings))
    return found.withColumn("score", six("score"))


@query("semantic_search_topic", """
    select query_id, knowledge_id, round(score, 6) score, rank from (
      select *, row_number() over (partition by query_id order by score desc, knowledge_id) rank
      from s_scores where topic_id = '42') where rank <= 10""")
def semantic_search_topic(c: Context) -> DataFrame:
    return _out(semantic.cosine_top(c.questions, files.embedding_corpus(c.embeddings, topic="42")))


@query("join_query_vector", """
    select query_id, knowledge_id, round(score, 6) score from (
      select *, row_number() over (partition by query_id order by score desc, knowledge_id) rank from s_scores)
    where rank = 1""")
def join_query_vector(c: Context) -> DataFrame:
    """Each question's nearest row, scored once more by the pairwise expression."""
    best = semantic.cosine_top(c.questions, c.embeddings, fetch_n=1).select("query_id", "knowledge_id")
    vectors = c.embeddings.select("knowledge_id", F.col("embedding").alias("v"))
    asked = c.questions.select("query_id", F.col("embedding").alias("q"))
    pairs = best.join(asked, "query_id").join(vectors, "knowledge_id")
    return pairs.select("query_id", "knowledge_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))


@query("topk_lexical", _LEXICAL)
def topk_lexical(c: Context) -> DataFrame:
    return _out(lexical.bm25_top(c.questions, c.refresh.eligible))


@query("topk_lexical_index", _LEXICAL)
def topk_lexical_index(c: Context) -> DataFrame:
    """The same rows from the stored postings."""
    return _out(inverted.bm25_top(c.questions, c.lexical_index))


@query("lexical_search", """
    select l.query_id, l.knowledge_id, l.rank, round(l.score, 6) score, e.topic_id, e.title, e.summary
    from l_top l join v_eligible e on l.knowledge_id = e.knowledge_id""")
def lexical_search(c: Context) -> DataFrame:
    found = inverted.bm25_top(c.questions, c.lexical_index)
    return semantic.with_details(found, files.lexical_corpus(c.refresh.eligible)).withColumn("score", six("score"))


@query("lexical_search_topic", "select query_id, knowledge_id, rank, round(score, 6) score from w_top")
def lexical_search_topic(c: Context) -> DataFrame:
    return _out(lexical.bm25_top(c.questions, files.lexical_corpus(c.refresh.eligible, topic="42")))


@query("agg_bm25_stats", "select term, df, round(idf, 6) idf from l_idf")
def agg_bm25_stats(c: Context) -> DataFrame:
    """As stored with the index; ``lexical.term_statistics`` computes them for a scan."""
    return inverted.term_weights(c.lexical_index).select("term", "df", F.round("idf", 6).alias("idf"))


# ---- merge, re-check, search -------------------------------------------------------------------

def _lists(c: Context) -> list[DataFrame]:
    return hybrid.candidate_lists(c.questions, c.embeddings, c.refresh.eligible)


_MERGED = "select query_id, knowledge_id, round(semantic_score, 6) semantic_score, round(lexical_score, 6) lexical_score, round(hybrid_score, 6) hybrid_score, rank from h_ranked"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in ("semantic_score", "lexical_score", "hybrid_score")})


@query("normalize_scores", "select query_id, knowledge_id, rank, round(score, 6) score from n_lex")
@query("agg_minmax_norm", "select query_id, knowledge_id, rank, round(score, 6) score from n_lex")
def normalize_scores(c: Context) -> DataFrame:
    return _out(hybrid.normalize(lexical.bm25_top(c.questions, c.refresh.eligible)))


@query("join_hybrid_merge", _MERGED)
@query("distinct_merge_by_id", _MERGED)
def join_hybrid_merge(c: Context) -> DataFrame:
    return _rounded(hybrid.merge(*_lists(c), top_n=20))


@query("merge_and_rerank", _MERGED + " where rank <= 5")
@query("topk_hybrid", _MERGED + " where rank <= 5")
def merge_and_rerank(c: Context) -> DataFrame:
    return _rounded(hybrid.merge(*_lists(c)))


@query("governance_filter", "select query_id, knowledge_id, rank from h_live")
@query("join_governance_recheck", "select query_id, knowledge_id, rank from h_live")
@query("set_membership", "select query_id, knowledge_id, rank from h_live")
def governance_filter(c: Context) -> DataFrame:
    merged = staged(hybrid.merge(*_lists(c), top_n=10), "merged")
    return hybrid.recheck(merged, c.refresh.eligible).select("query_id", "knowledge_id", "rank")


@query("topk_overfetch", "select query_id, knowledge_id, rank from h_search")
def topk_overfetch(c: Context) -> DataFrame:
    merged = staged(hybrid.merge(*_lists(c), top_n=10), "merged")
    return hybrid.rerank(hybrid.recheck(merged, c.refresh.eligible), 5).select("query_id", "knowledge_id", "rank")


@query("search_knowledge", """
    select h.query_id, h.rank, h.knowledge_id, round(h.hybrid_score, 6) hybrid_score,
      round(h.semantic_score, 6) semantic_score, round(h.lexical_score, 6) lexical_score, k.topic_id, k.title, k.summary
    from h_search h join b_k1 k on h.knowledge_id = k.knowledge_id""")
def search_knowledge(c: Context) -> DataFrame:
    eligible = c.refresh.eligible
    return _rounded(hybrid.search(
        c.questions, files.embedding_corpus(c.embeddings), files.lexical_corpus(eligible), eligible
    ))


@query("search_knowledge_index", """
    select query_id, rank, knowledge_id, round(hybrid_score, 6) hybrid_score from h_search""")
def search_knowledge_index(c: Context) -> DataFrame:
    """The same answers from the stored indexes of words and vectors."""
    eligible = c.refresh.eligible
    found = hybrid.search(c.questions, files.embedding_corpus(c.embeddings), files.lexical_corpus(eligible), eligible,
                          words=c.lexical_index, vectors=c.vector_index)
    return found.select("query_id", "rank", "knowledge_id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("drift_report", """
    select knowledge_id, topic_id from b_embeddings where knowledge_id not in (select knowledge_id from v_eligible)""")
def drift_report(c: Context) -> DataFrame:
    return hybrid.drift(c.embeddings, c.refresh.eligible)


# ---- evaluation --------------------------------------------------------------------------------

ANCHOR = 5


def _run(words: Column, first: Column, n: int) -> Column:
    """A hash of ``n`` words from place ``first`` on."""
    return F.xxhash64(F.lit(n), *[F.get(words, first + i) for i in range(n)])


def _within(c: Context) -> DataFrame:
    """(query_id, within): the first document, by id, that contains a question's text whole.

    Five words from inside the text must stand in the document, so a hash of those is joined on and only
    such pairs are compared in full.  The first and last word may be parts of longer ones there.
    A text of three to six words has its second word joined on; a shorter one has no inner word and is
    matched by its first.  Texts are read where they are and no list of words is written.
    """
    needle = F.lower("question")
    parts = F.size("parts")
    anchor = (
        F.when(parts >= ANCHOR + 2, _run(F.col("parts"), F.lit(1), ANCHOR))
        .when(parts >= 3, _run(F.col("parts"), F.lit(1), 1)).when(parts >= 1, _run(F.col("parts"), F.lit(0), 1))
    )
    asked = staged(c.questions.select("query_id", needle.alias("needle"), tokens(needle).alias("parts")).select(
        "query_id", "needle", anchor.alias("anchor"), (parts < ANCHOR + 2).alias("short")), "asked")
    lengths = [ANCHOR, 1] if asked.where("short").limit(1).count() else [ANCHOR]
    docs = c.table("documents").select(F.concat(F.lit("know_"), F.col("doc_id").cast("string")).alias("knowledge_id"), "text")

    def runs(words: Column, n: int) -> Column:
        last = F.size(words) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _run(words, i, n))

    # Inside a lambda of one element the word list is bound, not split anew for every position.
    found = F.flatten(F.transform(F.array(tokens(F.col("text"))), lambda words: F.concat(*[runs(words, n) for n in lengths])))
    anchors = docs.select("knowledge_id", F.explode(F.array_distinct(found)).alias("anchor"))
    pairs = sized_join(anchors, asked, "anchor", "inner", ["knowledge_id"]).select("knowledge_id", "query_id", "needle")
    full = attach(pairs, docs, "knowledge_id", ["query_id"])
    holds = full.where(F.contains(F.lower("text"), F.col("needle")))
    return holds.groupBy("query_id").agg(F.min("knowledge_id").alias("within"))


def _cases(c: Context) -> DataFrame:
    """The labelled benchmark as the evaluation reads it: JSON cases, written once per session."""
    if "cases" not in c.made:
        path = c.scratch("benchmark")
        _label(c).write.json(path)
        c.made["cases"] = path
    return files.read_benchmark(c.spark, c.made["cases"], multi_line=False)


def _label(c: Context) -> DataFrame:
    own = F.regexp_replace("query_id", "^q_", "know_")
    labels = c.bind("b_k1").select("knowledge_id", "review_status")
    asked = sized_join(c.questions.withColumn("knowledge_id", own), labels, "knowledge_id", "inner", ["query_id"])
    rejected = F.col("review_status") != "APPROVED"
    return asked.join(_within(c), "query_id", "left").select(
        F.col("query_id").alias("id"), "question",
        F.when(F.col("within").isNotNull(), "lexical").otherwise("semantic").alias("style"),
        F.when(rejected, "governance_reject").otherwise("grounded").alias("type"),
        F.array_distinct(F.array_compact(F.array("knowledge_id", "within"))).alias("expected_knowledge_ids"),
        F.when(rejected, F.col("knowledge_id")).alias("excluded_knowledge_id"),
        F.when(rejected, F.concat(F.lit("review status "), F.col("review_status"))).alias("excluded_reason"),
    )


def _results(c: Context) -> DataFrame:
    lists = evaluation.candidates(*_lists(c), c.refresh.eligible)
    return evaluation.eval_cases(_cases(c), lists)


@query("scan_benchmark_json", """
    select c.id, c.question, c.style, c.type, string_agg(x.knowledge_id, ',' order by x.knowledge_id) expected,
      c.excluded_knowledge_id from e_cases c join e_expected x on x.query_id = c.id group by all""")
def scan_benchmark_json(c: Context) -> DataFrame:
    """The cases as JSON array documents of at most 500 cases each, read back."""
    path = c.scratch("benchmark_arrays")
    body = F.to_json(F.struct(*S.BENCHMARK_CASE.names))
    document = F.floor(F.regexp_extract("id", r"(\d+)$", 1).cast("long") / 500)
    array = F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]"))
    arrays = _cases(c).select(document.alias("part"), body.alias("j")).groupBy("part").agg(array.alias("value"))
    arrays.write.partitionBy("part").text(path)  # one folder, so one file, per document
    return files.read_benchmark(c.spark, path).select(
        "id", "question", "style", "type",
        F.array_join(F.array_sort("expected_knowledge_ids"), ",").alias("expected"), "excluded_knowledge_id",
    )


@query("join_expected_hits", """
    select x.query_id, coalesce(bool_or(s.rank is not null), false) hit from e_expected x
    left join (select * from s_top where rank <= 5) s on s.query_id = x.query_id and s.knowledge_id = x.knowledge_id
    group by x.query_id""")
@query("eval_hit_at_k", """
    select x.query_id, coalesce(bool_or(s.rank is not null), false) hit from e_expected x
    left join (select * from s_top where rank <= 5) s on s.query_id = x.query_id and s.knowledge_id = x.knowledge_id
    group by x.query_id""")
def eval_hit_at_k(c: Context) -> DataFrame:
    expected = _cases(c).select(
        F.col("id").alias("query_id"), F.explode("expected_knowledge_ids").alias("knowledge_id"))
    return evaluation.hits_at_k(semantic.cosine_top(c.questions, c.embeddings), expected)


@query("eval_run_case", "select * from e_results")
def eval_run_case(c: Context) -> DataFrame:
    return _results(c)


_RATES = """
    select coalesce(style, 'all') style, count(*) n,
      count(*) filter (semantic_hit) semantic_hits, count(*) filter (lexical_hit) lexical_hits,
      count(*) filter (hybrid_hit) hybrid_hits, count(*) filter (semantic_empty) semantic_emptys,
      count(*) filter (lexical_empty) lexical_emptys, count(*) filter (hybrid_empty) hybrid_emptys
    from e_results where type = 'grounded' group by rollup (style)"""


@query("agg_eval_rates", _RATES)
def agg_eval_rates(c: Context) -> DataFrame:
    return evaluation.eval_summary(_results(c))


@query("eval_summary", """
    select 'case' part, type, style, id, 1 n,
      case when type = 'grounded' then cast(semantic_hit as bigint) end semantic_hits,
      case when type = 'grounded' then cast(lexical_hit as bigint) end lexical_hits,
      case when type = 'grounded' then cast(hybrid_hit as bigint) end hybrid_hits,
      case when type = 'grounded' then cast(semantic_empty as bigint) end semantic_emptys,
      case when type = 'grounded' then cast(lexical_empty as bigint) end lexical_emptys,
      case when type = 'grounded' then cast(hybrid_empty as bigint) end hybrid_emptys,
      cast(excluded_id_was_a_raw_candidate as bigint) raw_candidates,
      cast(excluded_id_correctly_dropped as bigint) correctly_dropped
    from e_results
    union all
    select 'total', 'grounded', s.style, null, count(r.type),
      count(*) filter (r.semantic_hit), count(*) filter (r.lexical_hit), count(*) filter (r.hybrid_hit),
      count(*) filter (r.semantic_empty), count(*) filter (r.lexical_empty), count(*) filter (r.hybrid_empty), null, null
    from (values ('semantic'), ('lexical'), ('all')) s(style)
    left join e_results r on r.type = 'grounded' and s.style in (r.style, 'all') group by s.style
    union all
    select 'total', 'governance_reject', 'all', null, n, null, null, null, null, null, null, raw_candidates, correctly_dropped
    from (select count(*) n,
      count(*) filter (excluded_id_was_a_raw_candidate) raw_candidates,
      count(*) filter (excluded_id_correctly_dropped) correctly_dropped
    from e_results where type = 'governance_reject')""")
def eval_summary(c: Context) -> DataFrame:
    """Every case, the rates by style and overall, and the rejections, from one run over the cases."""
    return evaluation.summarize(staged(_results(c), "results"))


# ---- embedding job -----------------------------------------------------------------------------

_STAMP = "2025-07-01 00:00:00"


@query("embed_corpus", """
    select knowledge_id, topic_id, title, summary, 'hashed-words' embedding_model,
      timestamp '2025-07-01' embedded_at, 64 width, length(regexp_replace(summary, '\\s', '', 'g')) > 0 unit,
      round(coalesce((select sum((slot + 1) * v) / nullif(sqrt(sum(v * v)), 0) from x_docs d where d.knowledge_id = e.knowledge_id), 0.0), 6) weighted
    from v_eligible e""")
def embed_corpus(c: Context) -> DataFrame:
    index = embedding.build_index(c.refresh.eligible, F.lit(_STAMP).cast("timestamp_ntz"))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # Every component counts with its place, so two different vectors hardly agree.
    weighted = F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)
    return index.withColumns({"width": F.size("embedding"), "unit": F.abs(length - 1) < 1e-9, "weighted": weighted}).drop("embedding")


@query("embed_corpus_refresh", """
    select knowledge_id, topic_id, title, summary, doc % 3 = 0 as fresh,
      round(coalesce((select sum((slot + 1) * v) / nullif(sqrt(sum(v * v)), 0) from x_docs d where d.knowledge_id = e.knowledge_id), 0.0), 6) weighted
    from (select *, cast(replace(knowledge_id, 'know_', '') as bigint) doc from v_eligible) e""")
def embed_corpus_refresh(c: Context) -> DataFrame:
    """An index over older texts, refreshed: every third record is new or has another text by now, and every
    record in it that is not eligible goes."""
    third = F.regexp_replace("knowledge_id", "^know_", "").cast("long") % 3 == 0
    older = c.refresh.eligible.where(~third | (F.length("title") % 2 == 0)).withColumn(
        "summary", F.when(third, F.concat(F.lit("before: "), "summary")).otherwise(F.col("summary")))
    gone = older.where(third).withColumn("knowledge_id", F.concat(F.lit("gone_"), "knowledge_id"))
    before = staged(embedding.build_index(older.union(gone), F.lit("2025-06-01 00:00:00").cast("timestamp")), "before")
    index = embedding.refresh_index(c.refresh.eligible, before, F.lit(_STAMP).cast("timestamp"))
    weighted = F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)
    fresh = F.col("embedded_at") == F.lit(_STAMP).cast("timestamp")
    return index.select("knowledge_id", "topic_id", "title", "summary", fresh.alias("fresh"), weighted.alias("weighted"))


@query("chunk_text", "select knowledge_id chunk_id, knowledge_id, summary from v_eligible")
def chunk_text(c: Context) -> DataFrame:
    """One record is one chunk."""
    return c.refresh.eligible.select(F.col("knowledge_id").alias("chunk_id"), "knowledge_id", "summary")


@query("embed_query", """
    select query_id, knowledge_id, rank, round(score, 6) score from (
      select *, row_number() over (partition by query_id order by score desc, knowledge_id) rank from x_scores) where rank <= 10""")
def embed_query(c: Context) -> DataFrame:
    """Questions embedded on the fly against a freshly built index: semantic search end to end."""
    index = staged(embedding.build_index(c.refresh.eligible, F.lit(_STAMP).cast("timestamp")), "index")
    asked = embedding.embed_queries(c.questions.select("query_id", "question"))
    return _out(semantic.cosine_top(asked, index))


# ---- scalar functions --------------------------------------------------------------------------

@query("scalar_functions", f"""
    select doc_id, array_to_string({_tokens("text")}, ' ') words, coalesce(regexp_full_match(text, '\\s*'), true) blank,
      starts_with(text, 'E') e, round_even(n_chars / 100.0, 1) hundreds
    from documents""")
def scalar_functions(c: Context) -> DataFrame:
    from lorekeep.functions.text import is_blank

    text = F.col("text")
    return c.table("documents").select(
        "doc_id", F.array_join(tokens(text), " ").alias("words"), is_blank(text).alias("blank"),
        text.startswith("E").alias("e"), F.bround(F.col("n_chars") / 100.0, 1).alias("hundreds"),
    )
