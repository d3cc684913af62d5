"""The queries op1 to op13, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import branch_merge, conversation_repair, jaccard, language_model, merge_repair_sql, mtree, packing, quality, sentencepiece_codec, store, subword_classifier, token_counts, token_files, toxicity, url_filter


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after four edits: a word put at the start, the middle third's first 40 characters
    replaced, 25 characters cut at the middle, and a line added at the end."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    trees = token_counts.trees(_read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    n = F.length("text")
    edit = lambda at, cut, put: F.struct(at.cast("int").alias("at"), F.lit(cut).alias("del"), F.lit(put).alias("ins"))
    edits = F.array(edit(F.lit(0), 0, "Draft "), edit(F.floor(n / 3), 40, " [removed]"), edit(F.floor(n / 2), 25, ""), edit(n + 100, 0, "\nEnd of file."))
    out = token_counts.apply_edits(trees.withColumn("edits", edits), path)
    return out.select("doc_id", "n_tokens_before", "n_tokens", F.length("text").cast("long").alias("n_chars"), F.size("counts").alias("n_leaves"), "n_edits", "chars_encoded", F.crc32("text").alias("text_crc32"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), RULES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), mtree.whole(rows, "embedding").alias("v"))
    return mtree.top_k(whole, whole.where("vec_id % 50 = 0"), 5)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, model)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the best path over scores, the text that they decode to, and the library's ids beside them."""
    rows = sentencepiece_codec.round_trip(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), sentencepiece_codec.VITERBI)
    same = F.translate("text", "▁", " ") == F.col("decoded")
    crc = lambda c: F.crc32(F.array_join(F.col(c).cast("array<string>"), " "))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), crc("ids").alias("ids_crc32"), F.size("library_ids").cast("long").alias("n_library_ids"), crc("library_ids").alias("library_ids_crc32"),
        F.crc32("decoded").alias("decoded_crc32"), same.alias("round_trip"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = lambda: F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), where=~held_out())
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), drop_space=True)
    return token_files.summary(token_files.read(spark, path))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = branch_merge.merge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = lambda: F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = subword_classifier.train(docs, _read(spark, sf_dir, "labels"), where=~held_out())
    out = subword_classifier.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one turn in twenty left out, one emptied, one without stops, one said twice, and one put into the user's mouth."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    rows = rows.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversation_repair.repair(rows, damaged(rows))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1,
    "op2_url_filters": op2,
    "op3_top_k_search": op3,
    "op4_jaccard_join": op4,
    "op5_quality_rules": op5,
    "op6_best_fit_packing": op6,
    "op7_lm_scoring": op7,
    "op8_sentencepiece": op8,
    "op9_toxicity": op9,
    "op10_token_files": op10,
    "op11_branch_merge": op11,
    "op12_quality_classifier": op12,
    "op13_conversation_repair": op13,
    "pipeline": pipeline,
}

def _op2_sql(depth: int = 8) -> str:
    """The URL filter for paths of up to ``depth`` segments, one set of tables for each level of the tree."""
    tables = [
        r"""u as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages)""",
        r"""ru as materialized (
            select *, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
                case when rule in ('example.com/de/', 'net/') then 'block' when rule is not null then 'allow' end as ruled,
                list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(lower(x), '^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)(\.[a-z]+)?$') then '*' || regexp_extract(x, '(\.[a-z]+)?$', 0) when regexp_matches(x, '^[*+\\]') then '\' || x else x end) as shape
            from u)""",
        """l0 as materialized (
            select host, shape, shape as t, count(*) as urls, count(*) filter (where ruled = 'block') as blocked, count(ruled) as labelled
            from (select distinct host, path, shape, ruled from ru) group by host, shape)""",
    ]
    for k in range(depth):
        tables.append(f"""w{k} as (
            select *, sum(n) over (partition by host, above) as n_all from (select host, t[1:{k}] as above, t[{k + 1}] as s, sum(urls) as n from l{k} where len(t) > {k} group by all))""")
        tables.append(f"""p{k} as materialized (
            select host, above, coalesce(list(s) filter (where n * 16 > n_all), []) as often from w{k} group by host, above having count(*) filter (where n * 16 <= n_all) >= 16)""")
        tables.append(f"""l{k + 1} as materialized (
            select l.host, shape, case when len(t) > {k} and not list_contains(often, t[{k + 1}]) then list_concat(t[1:{k}], ['*'], t[{k + 2}:]) else t end as t, urls, blocked, labelled
            from l{k} l left join p{k} p on l.host = p.host and t[1:{k}] = above)""")
    tables.append(f"""m{depth} as materialized (select host, t, sum(blocked) as blocked, sum(labelled) as labelled, t as node, false as fixed from l{depth} group by host, t)""")
    for d in range(depth, 0, -1):
        tables.append(f"""o{d} as (
            select *, sum(b) over w as b_all, sum(l) over w as l_all, count(*) over w as siblings
            from (select host, node, node[1:{d - 1}] as above, cast(sum(blocked) as double) as b, cast(sum(labelled) as double) as l from m{d} where not fixed and len(node) = {d} group by all)
            window w as (partition by host, above))""")
        tables.append(f"""e{d} as (
            select *, bool_and(alike) over (partition by host, above) as every
            from (select *, siblings = 1 or (l >= 5 and l_all - l >= 5 and power(b * (l_all - l) - (b_all - b) * l, 2) * l_all <= 3.84e0 * l * (l_all - l) * b_all * (l_all - b_all)) as alike from o{d}))""")
        tables.append(f"""x{d} as (select distinct host as xh, node[1:{d - 1}] as xa from m{d} where fixed and len(node) >= {d})""")
        tables.append(f"""v{d} as materialized (select host as vh, node as vn, alike, every and xh is null as up from e{d} left join x{d} on host = xh and above = xa)""")
        tables.append(f"""m{d - 1} as materialized (
            select host, t, blocked, labelled, case when up then node[1:{d - 1}] when alike then list_concat(node[1:{d - 1}], ['+']) else node end as node, fixed or not coalesce(up, true) as fixed
            from m{d} left join v{d} on not fixed and len(node) = {d} and host = vh and node = vn)""")
    tables += [
        "br as materialized (select host, t, blocked, labelled, '/' || array_to_string(node, '/') as template from m0)",
        "o as (select coalesce(sum(blocked) / nullif(cast(sum(labelled) as double), 0), 0e0) as prior from br)",
        "j as (select host, template, (sum(blocked) + 4e0 * any_value(prior)) / (sum(labelled) + 4e0) as purity, count(*) as merged from br, o group by host, template)",
    ]
    return "with " + ",\n".join(tables) + f"""
        select ru.page_id, ru.host, ru.path, ru.rule, coalesce(ruled, case when purity >= 0.8 then 'block' else 'allow' end) as verdict, br.template, purity, merged
        from ru join l{depth} lf on ru.host = lf.host and ru.shape = lf.shape join br on lf.host = br.host and lf.t = br.t join j on j.host = br.host and j.template = br.template
    """


ORACLE = {
    "op2_url_filters": _op2_sql(),
    "op3_top_k_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 5
    """,
    "op4_jaccard_join": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10ffff}]+') as w from documents where doc_id is not null
        ), g as (
            select distinct doc_id, list_slice(w, i, i + 4) as gram
            from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from d where len(w) > 0)
        ), n as (select doc_id, count(*) as n from g group by doc_id),
        p as (
            select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all
        ), l as (
            select x, y, k = nx.n and k = ny.n as same from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 9 * k >= 4 * (nx.n + ny.n)
        ), c as (
            select doc_id as node, doc_id as root from d
            union
            select l.y, c.root from c join l on l.x = c.node
        )
        select d.doc_id, (select min(root) from c where node = d.doc_id) as class_id,
            least(d.doc_id, coalesce((select min(y) from l where x = d.doc_id and same), d.doc_id)) as copy_id,
            (select count(*) from l where x = d.doc_id) as n_links
        from d
    """,
    "op11_branch_merge": merge_repair_sql.OP11,
    "op13_conversation_repair": merge_repair_sql.OP13,
}
