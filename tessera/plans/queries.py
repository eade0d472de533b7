"""Registered queries: each applies an operator to the given tables in the roles that tables.py gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import citations, evidence, incremental, inventory, migration, records, retrieval, rules, schema, search
from ..operators.schema import Field
from ..sources import corpus
from ..sources.shared import shared_folder, written
from ..streaming import corpus as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """documents as one-page text files of the folder named by their source; a toxic one is for game masters."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", path.alias("path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("display_name"), F.col("source").alias("folder_name"), F.lit("Text").alias("type"), F.lit(1).alias("page"), "text",
        F.when(F.col("toxic") == 1, "gm").otherwise("players").alias("visibility"), F.when(F.col("source").isin("src3", "src7"), "gm").otherwise("players").alias("folder_visibility"),
        F.when(F.col("doc_id") % 50 == 0, F.create_map(path, F.lit("players"))).otherwise(F.create_map().cast("map<string,string>")).alias("file_visibility"))


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks of one each, ordered by id within folders of ten."""
    return table(spark, d, "documents").select(F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"), F.concat(F.lit("f/"), F.floor(F.col("doc_id") / 10).cast("string")).alias("path"), F.lit(1).alias("page"), F.col("doc_id").alias("ordinal"), "text")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    all_ = v.select(F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("chunk_id"), "embedding")
    return v.where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), "embedding"), all_


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 1000).alias("mtime"), (F.col("doc_id") % 13 != 0).alias("available"),
                                                   F.element_at(F.array(*[F.lit(t) for t in ("PDF", "Text", "Markdown", "CBZ", "Image")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("type"), (F.col("doc_id") % 3 == 0).alias("scanned"), (F.col("doc_id") % 4 == 0).alias("ocr_current"), F.concat(F.lit("Name "), (F.col("doc_id") % 100).cast("string")).alias("display_name"))


def batches_of(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as retrieval batches: a customer's question, line numbers as its queries, two parts to a chunk."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("question_id"))
    li = table(spark, d, "lineitem").join(o, "l_orderkey").select("question_id", F.col("l_linenumber").alias("query_ord"), F.concat(F.lit("c"), F.expr("l_partkey div 2").cast("string")).alias("chunk_id"), F.round(F.col("l_discount") * F.col("l_quantity"), 4).alias("evidence_score"), "l_orderkey", "l_extendedprice").repartition("question_id")  # all that follows goes by question: dealt out once
    rank = F.row_number().over(Window.partitionBy("question_id", "query_ord").orderBy(F.desc("l_extendedprice"), "l_orderkey", "chunk_id"))
    return li.withColumn("rank", rank).select("question_id", "query_ord", (F.col("query_ord") == 1).alias("is_original"), "rank", "chunk_id", "evidence_score")


def texts_of(spark: SparkSession, d: str) -> DataFrame:
    """documents as the texts of chunks, those of a source and language under one path."""
    return table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat_ws("/", "source", "lang").alias("path"), "text")


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("chunk_id"), "turn", "role", "text")


def records_of(spark: SparkSession, d: str) -> DataFrame:
    """customers as records; a stored key is present unless the key number says otherwise."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 12).alias("level"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("archetype"), F.col("c_acctbal").alias("balance"),
                                                  F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") % 1000).alias("updated_at"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("level"))).otherwise(F.array(F.lit("level"), F.lit("archetype"))).alias("present"))


def selections_of(spark: SparkSession, d: str) -> DataFrame:
    """order lines as selected parts of the customer; 'equipped' when returned."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("record_id"), F.lit("part").alias("entity_type"), F.col("l_partkey").alias("entity_id"), F.lit("inventory").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "R").alias("equipped"))


def entities_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey % 17 <> 0").select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def effects_of(spark: SparkSession, d: str) -> DataFrame:
    e = entities_of(spark, d)
    when = F.when(F.col("size") % 3 == 0, F.lit("equipped")).when(F.col("size") % 3 == 1, F.lit("level >= 5"))
    power = e.select("entity_type", "entity_id", F.lit("power").alias("modifier"), (F.col("size") % 7).cast("double").alias("value"), when.alias("when"), F.when(F.col("size") % 2 == 0, F.concat(F.lit("Size "), F.col("size").cast("string"))).alias("label"))
    best = e.select("entity_type", "entity_id", F.lit("best").alias("modifier"), F.col("size").cast("double").alias("value"), F.lit(None).cast("string").alias("when"), F.lit(None).cast("string").alias("label"))
    return power.unionByName(best)


SLOTS = [("home", "reference", "nation", None), ("skills", "multi_reference", "part", None), ("inventory", "collection", "part", "item")]


def characters_of(spark: SparkSession, d: str) -> DataFrame:
    """customers as records with a reference, a list and a collection: order lines are their inventory, by order and line."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("record_id"))
    row = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), "l_partkey", F.when(F.col("l_linenumber") < 6, F.col("l_partkey").cast("string")).alias("item"), (F.col("l_returnflag") == "R").alias("equipped"), F.when(F.col("l_linenumber") == 7, F.col("l_linestatus")).alias("custom_name"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("notes"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("record_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    items = F.transform("l", lambda r: F.struct(r.item.alias("item"), r.quantity.alias("quantity"), r.equipped.alias("equipped"), r.custom_name.alias("custom_name"), r.notes.alias("notes")))
    key = F.col("c_custkey")
    c = table(spark, d, "customer").join(rows, F.col("c_custkey") == F.col("record_id"), "left")
    return c.select(key.alias("record_id"), F.col("c_name").alias("name"), (key % 12).alias("level"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("archetype"), F.when(key % 5 != 0, F.col("c_nationkey").cast("string")).alias("home"),
                    F.array((key % 190 + 1).cast("string"), (key * 7 % 190 + 1).cast("string")).alias("skills"), records.resource(key % 30, key % 30 + 2).alias("hit_points"), items.alias("inventory"))


# ---- queries --------------------------------------------------------------------------------------

def visible_documents(spark, d):
    return search.visible(pages_of(spark, d), "players").select("doc_id", "path", "folder_name", "visibility")


def scoped_documents(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return search.scope(pages_of(spark, d), "src1", wanted).select("doc_id", "path", "folder_name")


def keyword_search(spark, d):
    return search.keyword_search(search.visible(pages_of(spark, d), "players"), queries_of(spark, d)).select("query_id", "path", "page", "score", "rank")


def snippet_search(spark, d):
    return search.keyword_search(pages_of(spark, d), queries_of(spark, d), 10).select("query_id", "path", "rank", "snippet")


def doc_terms_top(spark, d):
    return table(spark, d, "documents").select(F.explode(text.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def stem_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("t")).select(text.stem(F.lower("t")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def token_frequency(spark, d):
    return retrieval.token_totals(chunks_of(spark, d))


def query_phrases(spark, d):
    return queries_of(spark, d).select("query_id", F.posexplode(text.query_phrases(F.col("query"))).alias("pos", "phrase"))


def passages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.passages(F.col("text"))).alias("p")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"), F.max(F.length("p")).alias("longest"))


def revision_signals(spark, d):
    return table(spark, d, "documents").select("doc_id", text.revision_signal(F.col("text")).alias("revised"), text.rule_label_score(F.array(F.lit("rule")), F.array().cast("array<string>"), F.col("text")).alias("rule_label"))


def chunk_documents(spark, d):
    return chunking.chunk_documents(pages_of(spark, d).select("path", "page", "text"))


def chunk_stats(spark, d):
    c = chunk_documents(spark, d)
    return c.groupBy("path").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.min("ordinal").alias("first"))


def corpus_status(spark, d):
    return incremental.corpus_status(chunks_of(spark, d))


def doc_frequency(spark, d):
    return retrieval.document_frequency(retrieval.chunk_tokens(chunks_of(spark, d)), retrieval.prepared(queries_of(spark, d)))


def rare_tokens(spark, d):
    n = chunks_of(spark, d).agg(F.count("*").alias("n"))
    return doc_frequency(spark, d).where(F.col("df") <= F.greatest(F.lit(3), F.ceil(n.scalar() * 0.01))).select("token", "df")


def lexical_top100(spark, d):
    return retrieval.lexical_topk(retrieval.lexical_index(queries_of(spark, d), chunks_of(spark, d))).select("query_id", "chunk_id", "lexical_score", "coverage", "rare_coverage", "phrase_hits", "lexical_rank")


def semantic_top100(spark, d):
    return retrieval.semantic_topk(*vectors_of(spark, d)).select("query_id", "chunk_id", "semantic_score", "semantic_rank")


def rrf_fused(spark, d):
    lexical = retrieval.lexical_topk(retrieval.lexical_index(queries_of(spark, d), chunks_of(spark, d)))
    return retrieval.rrf_fuse(lexical, retrieval.semantic_topk(*vectors_of(spark, d))).select("query_id", "chunk_id", "lexical_rank", "semantic_rank", "hybrid_score")


def _scored(spark, d):
    q, c = queries_of(spark, d), chunks_of(spark, d)
    index = retrieval.lexical_index(q, c)
    return written(retrieval.evidence_score(retrieval.rrf_fuse(retrieval.lexical_topk(index), retrieval.semantic_topk(*vectors_of(spark, d))), index, c, q))


def evidence_ranked(spark, d):
    return retrieval.final_rank(_scored(spark, d)).select("query_id", "chunk_id", "evidence_score", "passage_score", "phrase_anchor", "rank")


def neighbor_rescue(spark, d):
    return retrieval.neighbor_rescue(_scored(spark, d), chunks_of(spark, d), queries_of(spark, d)).select("query_id", "chunk_id", "evidence_score", "neighbor_rescued")


def retrieve(spark, d):
    """The whole retrieval, from queries and chunks to ranked contexts."""
    return retrieval.retrieve(queries_of(spark, d), chunks_of(spark, d), *vectors_of(spark, d)).select("query_id", "chunk_id", "rank", "evidence_score", "context_text", "revision_candidate")


def retrieval_report(spark, d):
    return records.retrieval_diagnostics(retrieval.final_rank(_scored(spark, d)))


def vocabulary(spark, d):
    p = table(spark, d, "part")
    return records.vocabulary([p.select(F.col("p_partkey").alias("ord"), F.col(c).alias("value")) for c in ("p_brand", "p_type")])


def expand_queries(spark, d):
    """Conversations as questions of a record: a nation's names with short words are its terms, grouped by the word."""
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 25).alias("record_id"), F.col("text").alias("query"))
    groups = spark.createDataFrame([(0, "Thes", "x_the"), (1, "And", "no_field"), (2, "", "of_the"), (3, "ingss", "z"), (4, "zz", "to")], "group_no int, label string, field_id string")
    words = F.posexplode(F.array(*[F.lit(w) for w in ("the", "la", "der")])).alias("hint_no", "word")
    hints = table(spark, d, "nation").select(F.col("n_nationkey").alias("record_id"), "n_name").crossJoin(F.broadcast(groups)).select("record_id", "group_no", "label", "field_id", "n_name", words)  # five groups
    hints = hints.withColumn("term", F.when(F.col("hint_no") == 2, F.col("word")).otherwise(F.concat(F.initcap("n_name"), F.lit(" "), "word")))
    return records.expand_query_with_record(q, hints).select("query_id", "expanded")


def document_records(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("pdf", "TXT", "md", "exe", "cbz", "webp")]), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, d, "documents").select(F.col("source").alias("folder"), F.concat(F.lit("lib/"), "source", F.lit("/file "), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))
    folders = table(spark, d, "documents").select(F.col("source").alias("name")).distinct().select("name", F.when(F.col("name") == "src2", "gm").otherwise(F.lit(None).cast("string")).alias("visibility"), F.create_map(F.lit("lib/src2/file 2.md"), F.lit("players")).alias("file_visibility"))
    return inventory.document_records(files, folders).select("folder", "path", "filename", "display_name", "type", "doc_key", "visibility", "visibility_override")


def dedupe_documents(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("Folder"), (F.col("doc_id") % 7).cast("string")).alias("folder"), F.concat(F.lit("p"), F.expr("doc_id div 3").cast("string")).alias("path"), F.col("doc_id").alias("source_ord"))
    return inventory.dedupe_documents(docs).select("folder", "path", "source_ord")


def snapshot_diff(spark, d):
    f = files_of(spark, d)
    prev = f.where("doc_id % 10 <> 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return inventory.snapshot_diff(prev, f.where("doc_id % 11 <> 0"), f.where("not available").select("path"))


def confirm_removed(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("/", F.lit("root"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    sources = table(spark, d, "documents").select(F.concat_ws("/", F.lit("root"), "source").alias("path"), F.col("source").isin("src1", "src4", "src8").alias("available")).distinct()
    return inventory.confirm_removed(docs, sources)


def extraction_status(spark, d):
    f = files_of(spark, d)
    cache = f.where("doc_id % 2 = 0").select("path", "size", F.when(F.col("doc_id") % 14 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.lit(1).alias("version"))
    return inventory.extraction_status(f, cache).select("path", "status")


def artifact_gc(spark, d):
    f = files_of(spark, d)
    a = f.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("artifact"), F.when(F.col("doc_id") % 19 == 0, F.lit("gone")).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("size"), "mtime", (F.col("doc_id") % 8 != 0).alias("complete"), F.col("size").alias("bytes"))
    return inventory.artifact_gc(a, f, f.where("doc_id % 5 = 0").select("path", "size", "mtime"))


def prune_text(spark, d):
    f = files_of(spark, d)
    return inventory.prune_text(f.withColumn("size", F.col("size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).select("path", "size", "mtime"), f.where("doc_id % 9 <> 0"))


def text_status(spark, d):
    t = turns_of(spark, d)
    return inventory.text_status(t.select("path", F.col("turn").alias("page"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words")))


def ocr_backlog(spark, d):
    return inventory.ocr_backlog(files_of(spark, d))


def upload_names(spark, d):
    u = table(spark, d, "pages").select((F.col("page_id") % 20).alias("user"), F.concat(F.regexp_replace("url", r"^[a-z]+://|[0-9]+", ""), F.lit(" é.txt")).alias("name"), F.col("page_id").alias("arrival"))
    return inventory.upload_names(u).select("user", "arrival", "safe_name", "supported")


def natural_sort(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Page"), (F.col("p_partkey") % 120).cast("string"), F.lit("a"), (F.col("p_size") % 5).cast("string"), F.lit(".jpg")).alias("name"))
    return p.withColumn("pos", F.row_number().over(Window.partitionBy(F.col("p_partkey") % 10).orderBy(text.natural_key(F.col("name")), "p_partkey")))


def incremental_chunks(spark, d):
    pages = pages_of(spark, d).select("doc_id", "path", "page", "text")
    old = chunking.chunk_documents(pages.drop("doc_id"))
    new = pages.withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))).where("doc_id % 30 <> 1")
    changed, removed = pages.where("doc_id % 20 = 0").select("path"), pages.where("doc_id % 30 = 1").select("path")
    return incremental.update_chunks(old, new.drop("doc_id"), changed, removed)[0].select("id", "path", "ordinal")


def vector_reuse(spark, d):
    c = chunks_of(spark, d)
    old = c.where("ordinal % 4 <> 0").select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding"))
    changed, removed = c.where("ordinal % 70 = 0").select("path"), c.where("ordinal % 15 = 0").select("id")
    out = incremental.update_vectors(c, old, changed, removed, lambda r: r.select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding")))
    return out.select("chunk_id", "reused", F.round(F.get("embedding", F.lit(0)), 6).alias("e0"), F.round(F.get("embedding", F.lit(3)), 6).alias("e3"))


def corpus_versions(spark, d):
    """documents as two versions of a corpus, of which the first is written twice; what a reader finds of each."""
    docs, path = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")), shared_folder(spark, "corpus")
    corpus.write_corpus(docs.limit(1), path, 1)
    corpus.write_corpus(docs.where("doc_id % 3 <> 0").withColumn("n", F.col("n") + 1), path, 2)
    corpus.write_corpus(docs, path, 1)
    corpus.vacuum_corpus(spark, path)
    found = [corpus.read_corpus(spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _page_chunks(pages):
    return pages.select(F.concat_ws("/", "path", F.col("page").cast("string")).alias("id"), "path", "page", F.lit(0).alias("ordinal"), "text")


def streamed_vectors(spark, d):
    """conversations as documents of a page for each turn that come, change and go in three batches of a stream."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    folder = shared_folder(spark, "stream")
    later = F.when(F.col("k") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    drops = [t.withColumns({"seq": F.lit(0), "removed": F.lit(False)}), t.where("k % 5 = 0 or k % 7 = 0").withColumns({"text": later, "seq": F.lit(1), "removed": F.col("k") % 7 == 0}), t.where("k % 35 = 0").withColumns({"seq": F.lit(2), "removed": F.lit(False)})]
    for rows in drops:
        rows.drop("k").coalesce(1).write.mode("append").parquet(f"{folder}/in")  # a file is a batch here
    changes = spark.readStream.schema(drops[0].drop("k").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    encoder = lambda rows: rows.select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding"))
    streams.follow(changes, f"{folder}/store", f"{folder}/progress", encoder, _page_chunks).awaitTermination()
    return streams.current(spark, f"{folder}/store").select("chunk_id", F.round(F.get("embedding", F.lit(0)), 6).alias("e0"), F.round(F.get("embedding", F.lit(3)), 6).alias("e3"))


def kb_state(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "library_changed", "view": "text_current", "click": "chunks_current", "purchase": "embeddings_current", "error": "invalidate_text"}.items() for x in kv])
    e = table(spark, d, "events").select(F.col("user_id").alias("library_id"), "ts", F.col("event_id").alias("seq"), F.try_element_at(kinds, F.col("event_type")).alias("type"))
    return incremental.kb_state(e)


def batch_merge(spark, d):
    return evidence.merge_batches(batches_of(spark, d)).select("question_id", "chunk_id", "hits", "rr", "best_rank", "best_score", "original_hit", "original_rank", "original_score")


def evidence_rank(spark, d):
    return evidence.evidence_rank(evidence.merge_batches(batches_of(spark, d))).select("question_id", "chunk_id", "rank_score", "position")


def near_duplicates(spark, d):
    return evidence.near_duplicates(turns_of(spark, d), 0.5)


def evidence_select(spark, d):
    ranked = evidence.evidence_rank(evidence.merge_batches(batches_of(spark, d))).select("question_id", "chunk_id", "position", "original_hit", "original_score", "original_rank", "rank_score")
    return evidence.select_evidence(ranked, texts_of(spark, d)).select("question_id", "chunk_id", "rank_score")


def query_aware_rank(spark, d):
    """Conversations as questions: user turns ask, all turns are candidates."""
    t = turns_of(spark, d)
    texts = t.select(F.concat_ws("/", "path", "chunk_id").alias("chunk_id"), "path", "text")
    merged = t.select("question_id", F.concat_ws("/", "path", "chunk_id").alias("chunk_id"), F.round(F.length("text") / 10000, 6).alias("best_score"), F.col("turn").alias("best_rank"), (F.length("text") % 10 / 10).alias("passage_score"))
    return evidence.query_aware_rank(merged, t.where("role = 'user'").select("question_id", F.col("text").alias("query")), texts).select("question_id", "chunk_id", "pipeline_score", "position")


def procedural_anchor(spark, d):
    """documents of a source as candidates; by their number some end with a clause of a procedure."""
    clause = F.element_at(F.array(*[F.lit(x) for x in ("", " You can buy it.", " A player may  pay the cost.", " This must not exceed the maximum", " Unless required, it is allowed.", "", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    c = table(spark, d, "documents").select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("question_id"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("chunk_id"), F.col("n_chars").alias("score"), F.concat(F.coalesce("text", F.lit("")), clause).alias("text"))
    return evidence.procedural_anchor(c).select("question_id", "chunk_id", "total", "strong", "medium")


def decisions(spark, d):
    lead = F.element_at(F.array(F.lit("**Yes**, "), F.lit("no - "), F.lit("Nothing "), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", evidence.decision(F.concat(lead, "text")).alias("decision"))


def _answers(spark, d):
    marked = F.regexp_replace("text", r"\. ", F.concat(F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit("].\n")))
    return table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), marked.alias("text"))


def answer_claims(spark, d):
    return citations.answer_claims(_answers(spark, d))


def citation_excerpts(spark, d):
    src = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("source_no"), "text")
    return citations.citation_excerpts(citations.answer_claims(_answers(spark, d)), src)


def numbered_sources(spark, d):
    return citations.numbered_sources(turns_of(spark, d).select("question_id", "chunk_id", F.col("turn").alias("rank"), F.col("turn").alias("page"), F.concat(F.lit("Turn of "), "role").alias("display_name"), "text"))


def record_defaults(spark, d):
    return rules.fill_defaults(records_of(spark, d), {"archetype": "Adventurer", "level": 1}).select("record_id", "level", "archetype")


def record_issues(spark, d):
    checks = [("level_range", (F.col("level") < 1) | (F.col("level") > 10), "error", "level out of range"), ("archetype_known", ~F.col("archetype").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "error", "unknown archetype"), ("balance_positive", F.col("balance") < 0, "warning", "negative balance")]
    return rules.issues(records_of(spark, d), "record_id", checks)


DECLARED = [Field("name", "text", required=True), Field("level", "integer", minimum=1, maximum=10), Field("balance", "decimal", minimum=0), Field("archetype", "enum", options=("BUILDING", "MACHINERY")), Field("active", "boolean"),
            Field("inventory", "collection", required=True, items=(Field("item", "reference"), Field("quantity", "integer", required=True, minimum=2), Field("custom_name", "text")), custom=True)]


def declared_issues(spark, d):
    """customers as JSON with their orders as rows; some keys are unknown, missing, null or of another type."""
    key, o = F.col("c_custkey"), table(spark, d, "orders")
    n = F.col("o_orderkey")
    row = F.to_json(F.struct(F.when(n % 4 != 0, F.col("o_orderpriority")).alias("item"), F.when(n % 9 != 0, n % 7).alias("quantity"), F.when(n % 8 == 0, F.lit(" ")).when(n % 12 == 0, F.lit("own")).alias("custom_name"), F.when(n % 10 == 0, 1).alias("extra")))
    rows = o.groupBy(F.col("o_custkey").alias("record_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.when(n % 15 == 0, F.lit("5")).otherwise(row).alias("r")))), lambda x: x.r), ",").alias("rows"))
    c = table(spark, d, "customer").join(rows, key == F.col("record_id"), "left")
    level = F.when(key % 11 == 0, F.lit('"x"')).when(key % 13 == 0, F.lit("null")).otherwise((key % 14).cast("string"))
    whole = F.concat(F.lit('{"name":"'), F.when(key % 6 == 0, "").otherwise(F.col("c_name")), F.lit('","level":'), level, F.lit(',"balance":'), F.col("c_nationkey").cast("string"), F.lit(".5"), F.when(key % 10 == 0, ',"nobody":1').otherwise(""), F.lit(',"archetype":"'), "c_mktsegment", F.lit('"'),
                     F.when(key % 17 == 0, ',"active":"yes"').otherwise(',"active":true'), F.when(key % 19 == 0, ',"inventory":{}').when(F.col("rows").isNull(), "").otherwise(F.concat(F.lit(',"inventory":['), "rows", F.lit("]"))), F.when(key % 23 == 0, "").otherwise("}"))
    return schema.declared_issues(c.select(key.alias("record_id"), whole.alias("data")), DECLARED)


def dangling_references(spark, d):
    return rules.dangling(selections_of(spark, d), entities_of(spark, d)).groupBy("record_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


def modifiers(spark, d):
    return rules.resolve_modifiers(records_of(spark, d).select("record_id", "level"), selections_of(spark, d), effects_of(spark, d), [("power", 1.0, "sum"), ("best", 5.0, "max")])


def modifier_provenance(spark, d):
    return rules.modifier_sources(selections_of(spark, d), effects_of(spark, d), entities_of(spark, d)).groupBy("record_id", "modifier").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.min_by("source_name", "seq").alias("first_source"))


def calculated(spark, d):
    m = modifiers(spark, d)
    rows = rules.calculate(records_of(spark, d).select("record_id", "level", "balance").join(m, "record_id"), [("power_score", "level * 2 + power", 0), ("rank_score", "power_score + floor(balance / 1000)", 1), ("tier", "case when rank_score > 100 then 'high' else 'low' end", 2)])
    return rows.select("record_id", F.round("power_score", 6).alias("power_score"), F.round("rank_score", 6).alias("rank_score"), "tier")


def limits(spark, d):
    return rules.limits(records_of(spark, d), selections_of(spark, d), "skills", "2 + floor(level / 3)", 1).drop("problem")


def limit_usage(spark, d):
    """What a record has in its account against a maximum of its level; both fail for some records."""
    found = rules.limits(records_of(spark, d), None, "account", "if(level = 7, level / 2, 3000 / (level - 2))", 500, usage="if(nation = 3, balance, floor(balance))")
    return rules.limit_messages(found, "Account", "{label}: {count} of {maximum}, {over_by} over {nothing}")


def _expressions(spark, d):
    """parts as rules over the part of half the number, their size and more; some refer to nothing that is there, some are no expressions."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    half = F.concat(F.lit("p"), F.expr("p_partkey div 2").cast("string"))
    expr = (F.when(key % 50 == 0, F.concat(half, F.lit(" +"))).when(key % 7 == 0, F.concat(half, F.lit(" * missing + len('p1')"))).when(key % 5 == 0, F.concat(F.lit("aggregate(sizes, 0, (a, x) -> a + x) + "), half))
            .when(key == 1, "size").otherwise(F.concat(F.lit("case when size > 3 then "), half, F.lit(" else stats.base + "), half, F.lit(" end"))))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("formula", "formula", "formula", "limit", "eligibility")]), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select(F.when(key == 1, "formula").otherwise(kind).alias("kind"), F.concat(F.lit("p"), key.cast("string")).alias("rule_id"), expr.alias("expr"))


def expression_levels(spark, d):
    return rules.rule_levels(rules.expression_edges(_expressions(spark, d))[0])


def expression_audit(spark, d):
    known = spark.createDataFrame([("size",), ("sizes",), ("stats",), ("p4",)], "name string")
    return rules.expression_audit(_expressions(spark, d), known)


def eligibility(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.when(F.col("n_regionkey") == 0, F.lit("level >= 3 and archetype = 'BUILDING'")).when(F.col("n_regionkey") == 1, F.lit("balance > 5000")).alias("rule"))
    return rules.eligibility(records_of(spark, d), e).groupBy("record_id").agg(F.count_if("eligible").alias("open"), F.count("*").alias("all_entities"))


def temporary_effects(spark, d):
    ops = F.element_at(F.array(*[F.lit(x) for x in ("add", "subtract", "multiply", "override")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", ops.alias("op"), (F.col("l_quantity") % 5).alias("value")))), lambda x: F.struct(x.op.alias("op"), x.value.alias("value"))).alias("rows"))
    return table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.round(rules.apply_effects(F.floor("o_totalprice"), F.col("rows")), 4).alias("value"))


def _edges(spark, d):
    """parts as rules that depend on the part of half the number."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2").cast("string")).alias("dep"))


def rule_levels(spark, d):
    return rules.rule_levels(_edges(spark, d))


def influence_map(spark, d):
    parts = table(spark, d, "part").agg(F.count("*").alias("n"))
    effects = table(spark, d, "events").withColumn("n", parts.scalar()).select(F.col("user_id").alias("record_id"), (F.col("event_id") * 7919 % F.col("n") + 1).cast("string").alias("field")).distinct()
    return rules.influence_map(effects, _edges(spark, d)).select("record_id", "field", F.array_join("sources", ",").alias("sources"))


def advancement(spark, d):
    return rules.advance(records_of(spark, d).select("record_id", "level", "balance"), "level < 10 and balance > 0", [("level", "level + 1"), ("balance", "round(balance - level * 10, 2)")])


def apply_conflicts(spark, d):
    drafts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("record_id"), (F.col("o_orderkey") % 1000).alias("base_updated_at"))
    return rules.apply_drafts(records_of(spark, d), drafts).select("o_orderkey", "record_id", "outcome")


def migrate_records(spark, d):
    r = records_of(spark, d).select("record_id", "name", "level", "balance", "archetype")
    out = rules.migrate(r, {"name": "text", "level": "integer", "balance": "decimal", "archetype": "enum"}, {"name": ("notes", ""), "level": ("decimal", 1.0), "balance": ("integer", 0), "note": ("text", "migrated")})
    return out.select("record_id", "name", "level", "balance", "note", F.array_join("warnings", "|").alias("warnings"))


def rule_audit(spark, d):
    p = table(spark, d, "part")
    edges = p.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.concat(F.lit("r"), (F.col("p_partkey") + F.col("p_size") * 100).cast("string")).alias("dep"))
    return rules.rule_audit(edges, p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 150).cast("string")).alias("name")))


def _forms(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(key.alias("record_id"), F.when(key % 3 != 0, F.col("c_name")).alias("name"), F.when(key % 4 == 0, F.lit(" ")).when(key % 7 == 0, F.lit("7a")).otherwise((key % 20).cast("string")).alias("level"), F.when(key % 6 == 0, F.lit("x")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
                    F.when(key % 2 == 0, F.lit("on")).alias("active"), F.concat_ws(",", "c_mktsegment", F.lit(""), "c_name").alias("skills"), (key % 9).cast("string").alias("hp__current"), F.when(key % 5 != 0, F.lit("10")).alias("hp__max"))


FORM = {"name": "text", "level": "integer", "balance": "decimal", "active": "boolean", "skills": "multi_reference", "hp": "resource"}


def coerced(spark, d):
    out = records.coerce(_forms(spark, d), FORM)[0]
    return out.select("record_id", "name", "level", "balance", "active", F.array_join("skills", "|").alias("skills"), F.col("hp.current").alias("hp"), F.col("hp.max").alias("hp_max"))


def coerce_issues(spark, d):
    return records.coerce(_forms(spark, d), FORM)[1]


def html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", corpus.html_text(F.col("html")).alias("text"))


def entities_issues(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.lit("part").alias("entity_type"), F.concat(F.when(F.col("p_partkey") % 40 == 0, "Bad ").otherwise("p"), (F.col("p_partkey") % 1500).cast("string")).alias("id"), F.when(F.col("p_partkey") % 33 != 0, F.col("p_name")).alias("name"), F.array("p_type").alias("tags"), F.col("p_partkey").alias("ord"))
    return corpus.entities_from(rows)[1]


def import_records(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("owner"), F.col("c_custkey").cast("string").alias("record_id"), F.col("c_acctbal").alias("balance"))
    return corpus.import_records(c.where("cast(record_id as bigint) % 3 = 0").withColumn("balance", F.lit(0.0)), c.where("cast(record_id as bigint) % 2 = 0"), "replace")


def records_for(spark, d):
    """Records that each nation's keeper sees: their own, and all of the region for its first nation."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("viewer"), F.col("n_regionkey").alias("group"), (F.col("n_nationkey") == F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))).alias("sees_all"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("owner")).join(F.broadcast(n.select(F.col("viewer").alias("owner"), "group")), "owner")
    return records.records_for(c, n).select("viewer", "own", "c_custkey")


def autofill(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("note"))
    return records.autofill_row(rows, entities_of(spark, d), "l_partkey", {"note": "brand"})


def selections(spark, d):
    return records.selections(characters_of(spark, d), SLOTS, {"quantity": "double", "equipped": "boolean"})


def _entities(spark, d):
    parts = table(spark, d, "part").select(F.lit("part").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.split("p_type", " ").alias("tags"),
                                            F.when(F.col("p_size") % 4 == 0, F.lit("level >= 6")).when(F.col("p_size") % 4 == 1, F.lit("100 / level > 20")).when(F.col("p_size") % 4 == 2, F.lit("nobody = 1")).alias("rule"), F.when(F.col("p_size") % 3 == 0, F.lit("Too early.")).alias("message"))
    return parts


def search_hints(spark, d):
    return records.search_hints(records.selections(characters_of(spark, d), SLOTS), _entities(spark, d))


def rendered_records(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    fields = [("name", "text", "Name"), ("level", "integer", "Level"), ("home", "reference", "Home"), ("skills", "multi_reference", "Skills"), ("hit_points", "resource", "Hit points"), ("inventory", "collection", "Inventory")]
    return records.render(characters_of(spark, d), fields, n)


def record_functions(spark, d):
    c = characters_of(spark, d)
    return c.select("record_id", records.half_even(F.col("level") / 2).cast("long").alias("half"), records.count(c, "skills").alias("skills"), records.count(c, "name").alias("letters"), records.count(c, "level").alias("none"),
                    F.round(records.rowsum(c, "inventory", "quantity"), 4).alias("quantity"), records.rowsum(c, "inventory", "notes").alias("no_number"), F.round(records.rowsum_where(c, "inventory", "quantity", "equipped", True), 4).alias("worn"),
                    records.rowcount(c, "inventory", "equipped", True).alias("n_worn"), records.nonempty_count(c, "inventory", "notes").alias("noted"), records.nonempty_count_where(c, "inventory", "notes", "equipped", True).alias("worn_noted"), records.resource_max(F.col("hit_points")).alias("most"))


def explanations(spark, d):
    c = characters_of(spark, d)
    c = c.join(modifiers(spark, d), "record_id").withColumn("load", F.round(records.rowsum(c, "inventory", "quantity"), 4))
    rows = rules.calculate(c, [("power_score", "level * 2 + power - load", 0)])
    sources = rules.modifier_sources(selections_of(spark, d), effects_of(spark, d), entities_of(spark, d))
    terms = [("power_score", 0, 1, "level * 2", "Level * 2"), ("power_score", 1, 1, "power", "Power"), ("power_score", 2, -1, "load", "Load"), ("rank", 0, 1, "power_score / level", "Power Score / Level")]
    out = records.explain_terms(rows, terms, sources)
    return out.select("record_id", "rule_id", "term_no", "label", F.round("value", 6).alias("value"), F.size("sources").alias("n_sources"), F.get("sources", F.lit(0)).source_name.alias("first_source"))


def explanation_inputs(spark, d):
    c = rules.calculate(characters_of(spark, d).join(modifiers(spark, d), "record_id"), [("power_score", "cast(level * 2 + power as bigint)", 0)])
    return records.explain_inputs(c, [("power_score", 0, "level"), ("power_score", 1, "power"), ("rank", 0, "power_score")], {"power", "best"}, {"power_score"}).withColumn("value", F.col("value").cast("double"))


def selected_ineligible(spark, d):
    c = characters_of(spark, d)
    return records.selected_ineligible(c.select("record_id", "level"), records.selections(c.select("record_id", "home", "skills"), SLOTS[:2]), _entities(spark, d))


def limits_where(spark, d):
    c = characters_of(spark, d)
    return records.limits_where(c.select("record_id", "level"), records.selections(c.select("record_id", "inventory"), SLOTS[2:]), _entities(spark, d), "brass", "1 + floor(level / 4)", ("BRASS",), {"brand": "Brand#11"}, 1).drop("problem")


def final_changes(spark, d):
    return records.final_changes(records_of(spark, d).select("record_id", "level", "balance"), [("level", "level / 2 + 1"), ("balance", "round(balance + level, 2)")], ("level",))


def rules_in_scope(spark, d):
    """Issues of parts as rules, where the parts of every third size are filled in at the step of their size."""
    p = table(spark, d, "part")
    issues = p.select((F.col("p_partkey") % 10).alias("record_id"), F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("message"))
    steps = p.where("p_size % 3 = 0").select(F.col("p_partkey").cast("string").alias("field"), (F.col("p_size") % 6).alias("step"))
    return records.rules_in_scope(issues, _edges(spark, d), steps, 2)


def placeholder_rows(spark, d):
    c = characters_of(spark, d)
    left = records.drop_placeholder_rows(c, "inventory", ("item",), {"quantity": 1.0})
    return c.select("record_id", F.coalesce(F.size(left), F.lit(-1)).alias("left"), F.coalesce(F.size("inventory"), F.lit(-1)).alias("all_rows"))


def effective_values(spark, d):
    """A calculated value and the one above it after temporary effects on both."""
    ops = F.element_at(F.array(*[F.lit(x) for x in ("add", "multiply", "subtract")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("record_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", ops.alias("op"), (F.col("o_orderkey") % 4).cast("double").alias("value")))), lambda x: F.struct(x.op.alias("op"), x.value.alias("value"))).alias("effects"))
    r = records_of(spark, d).select("record_id", "level").join(rows, "record_id", "left")
    out = rules.calculate(r, [("base", "level * 2", 0), ("total", "base + 10", 1)], {"base": F.col("effects")})
    return out.select("record_id", F.col("base").cast("double").alias("base"), F.col("total").cast("double").alias("total"))


def staged_effects(spark, d):
    """orders as temporary effects on a record's level, balance and score; a changed level switches modifiers on and off."""
    n = F.col("o_orderkey")
    target = F.element_at(F.array(*[F.lit(x) for x in ("level", "level", "balance", "power_score", "nobody")]), (n % 5 + 1).cast("int"))
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "subtract", "multiply", "add", "override")]), (n % 5 + 1).cast("int"))
    temporary = table(spark, d, "orders").select(F.col("o_custkey").alias("record_id"), target.alias("target"), n.alias("seq"), op.alias("op"), F.when(n % 5 == 2, 2).otherwise(n % 3).cast("double").alias("value"))
    r = records_of(spark, d).select("record_id", "name", "level", "balance")
    formulas = [("power_score", "level * 2 + power", 0), ("tier", "power_score + 10", 1)]
    out = rules.effective(r, selections_of(spark, d), effects_of(spark, d), [("power", 1.0, "sum")], formulas, temporary, ["name", "level", "balance"])
    return out.select("record_id", "level", "balance", "power", "power_score", "tier", F.array_join("modified", ",").alias("modified"))


def migrate_references(spark, d):
    """Customers whose list of parts, home and segment are checked against what the new system has."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    r = c.select(key.alias("record_id"), F.array((key % 190 + 1).cast("string"), (key * 7 % 230 + 1).cast("string")).alias("skills"), F.col("c_nationkey").cast("string").alias("home"), F.col("c_mktsegment").alias("archetype"))
    parts = table(spark, d, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").cast("string").alias("entity_id"))
    homes = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").cast("string").alias("entity_id"))
    out = rules.migrate(r, {"skills": "multi_reference", "home": "reference", "archetype": "enum"}, {"skills": ("multi_reference", None), "home": ("reference", ""), "archetype": ("enum", "OTHER")}, {"archetype": ["BUILDING", "MACHINERY"]}, {"skills": parts, "home": homes})
    return out.select("record_id", F.array_join("skills", ",").alias("skills"), "home", "archetype", F.array_join("warnings", "|").alias("warnings"))


OLD_FIELDS = [Field("name", "text"), Field("level", "integer"), Field("balance", "decimal"), Field("segment", "enum", options=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), Field("home", "reference", entity="nation"), Field("skills", "multi_reference", entity="part"), Field("archetype", "text"),
              Field("inventory", "collection", items=(Field("item", "reference", entity="part"), Field("quantity", "decimal"), Field("label", "text"), Field("gone", "text")))]
NEW_FIELDS = [Field("name", "notes", required=True), Field("level", "decimal", maximum=10), Field("balance", "integer", default="0"), Field("segment", "enum", options=("BUILDING", "MACHINERY"), default='"BUILDING"'), Field("home", "reference", entity="nation"), Field("skills", "multi_reference", entity="part"), Field("active", "boolean"),
              Field("inventory", "collection", items=(Field("item", "reference", entity="part"), Field("quantity", "integer", minimum=2), Field("label", "notes"), Field("own", "boolean")))]


def migrate_nested(spark, d):
    """customers as JSON, with their orders as rows and effects on two fields, on a new system whose parts and nations are fewer."""
    key, n = F.col("c_custkey"), F.col("o_orderkey")
    row = F.concat(F.lit('{"item":"'), (n % 230).cast("string"), F.lit('","quantity":'), (n % 7).cast("string"), F.when(n % 4 == 0, ".5").otherwise(""), F.lit(',"label":"'), "o_orderpriority", F.lit('","gone":"x"}'))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.when(n % 15 == 0, "5").otherwise(row).alias("r")))), lambda x: x.r), ",").alias("rows"))
    data = F.concat(F.lit('{"name":"'), "c_name", F.lit('","level":'), (key % 14).cast("string"), F.lit(',"balance":'), F.col("c_nationkey").cast("string"), F.when(key % 2 == 1, ".5").otherwise(".0"), F.lit(',"segment":"'), "c_mktsegment", F.lit('","home":"'), F.col("c_nationkey").cast("string"),
                    F.lit('","skills":["'), (key % 190 + 1).cast("string"), F.lit('","'), (key * 7 % 230 + 1).cast("string"), F.lit('"],"archetype":"a","inventory":['), F.coalesce("rows", F.lit("")), F.lit("]"), F.when(key % 23 == 0, "").otherwise("}"))
    effects = F.when(key % 3 == 0, F.concat(F.lit('{"level":[{"op":"add","value":'), (key % 5).cast("string"), F.lit('}],"archetype":[]}')))
    r = table(spark, d, "customer").join(rows, key == F.col("k"), "left").select(key.alias("record_id"), data.alias("data"), effects.alias("effects"))
    parts = table(spark, d, "part").where("p_size % 5 <> 0").select(F.lit("part").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"))
    homes = table(spark, d, "nation").where("n_regionkey <> 1").select(F.lit("nation").alias("entity_type"), F.col("n_nationkey").cast("string").alias("entity_id"))
    out = migration.migrate_declared(r, OLD_FIELDS, NEW_FIELDS, parts.unionByName(homes), effects="effects")
    return out.select("record_id", F.when(F.col("record_id") % 23 != 0, F.col("data")).alias("data"), "effects", F.array_join("warnings", "|").alias("warnings"))


def audit_effects(spark, d):
    """Rules that loop, effects of unknown parts and modifiers, modifiers with odd aggregates."""
    p = table(spark, d, "part")
    edges = p.select(F.col("p_name").alias("rule_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("dep")).union(p.select(F.concat(F.lit("loop"), (F.col("p_partkey") % 4).cast("string")), F.concat(F.lit("loop"), ((F.col("p_partkey") + 1) % 4).cast("string"))))
    effects = p.select(F.lit("part").alias("entity_type"), (F.col("p_partkey") * 2).alias("entity_id"), F.concat(F.lit("m"), (F.col("p_size") % 9).cast("string")).alias("modifier"))
    modifiers = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, "sum").when(F.col("id") % 3 == 1, "max").otherwise("mean").alias("aggregate"))
    entities = p.select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"))
    severities = p.select(F.col("p_name").alias("rule_id"), F.when(F.col("p_size") % 10 == 0, "fatal").otherwise("error").alias("severity")).distinct()
    return rules.rule_audit(edges, p.select(F.col("p_brand").alias("name")).distinct(), effects, modifiers, entities, severities)


def corpus_totals(spark, d):
    """documents as chunks and the vectors of the same numbers, one model to each label."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("chunk_id"), F.when(F.col("label") < 5, "small").otherwise("large").alias("model"), "embedding")
    return incremental.corpus_status(chunks_of(spark, d), v, "small")


def envelope_checks(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(F.when(key % 11 == 0, "other").otherwise("record").alias("format"), F.when(key % 7 != 0, F.lit(1)).otherwise(F.lit(2)).alias("format_version"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("owner"), key.alias("record_id"), F.when(key % 3 != 0, F.lit("core")).alias("system_id"))
    return corpus.check_envelopes(rows, "record", 1)[1].select("record_id", "problem")


QUERIES = {f.__name__: f for f in (
    visible_documents, scoped_documents, keyword_search, snippet_search, doc_terms_top, stem_frequency, token_frequency, query_phrases, passages, revision_signals, chunk_documents, chunk_stats, corpus_status,
    doc_frequency, rare_tokens, lexical_top100, semantic_top100, rrf_fused, evidence_ranked, neighbor_rescue, retrieve, retrieval_report, vocabulary, expand_queries, document_records, dedupe_documents, snapshot_diff,
    confirm_removed, extraction_status, artifact_gc, prune_text, text_status, ocr_backlog, upload_names, natural_sort, incremental_chunks, vector_reuse, corpus_versions, streamed_vectors, kb_state, batch_merge, evidence_rank, near_duplicates,
    evidence_select, query_aware_rank, procedural_anchor, decisions, answer_claims, citation_excerpts, numbered_sources, record_defaults, record_issues, declared_issues, dangling_references, modifiers, modifier_provenance, calculated,
    limits, limit_usage, expression_levels, expression_audit, eligibility, temporary_effects, rule_levels, influence_map, advancement, apply_conflicts, migrate_records, rule_audit, coerced, coerce_issues, html_pages, selections, record_functions, explanations, explanation_inputs, selected_ineligible, limits_where, final_changes, rules_in_scope, placeholder_rows, effective_values, staged_effects, migrate_references, migrate_nested, audit_effects, corpus_totals, envelope_checks, entities_issues, import_records, records_for, autofill, search_hints, rendered_records)}
