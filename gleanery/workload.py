"""The registered queries: the library's operators over the given tables.

``documents`` plays the indexed corpus, ``embeddings`` its vectors, ``pages``
web documents, ``conversations`` replies that quote each other, and ``orders``
with its customers and suppliers a mail archive (an order is a message from its
customer to the suppliers of its lines).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.config import Source
from gleanery.functions import addresses, analysis, headers, markup
from gleanery.functions import text as tx
from gleanery.functions.snippet import snippet
from gleanery.operators import changes, chunking, documents, embedding, entities, fusion, lexical, vectors
from gleanery.plans import embed as embedding_plan
from gleanery.plans import search as searching
from gleanery.plans.index import Index
from gleanery.plans.update import Outcome, merge_parts, update_source
from gleanery.session import shared_folder, ship_package, spread, stored
from gleanery.tables import table_loader, table_probes

DIGITS = 6  # published floats

# Parameters of the registered searches, shared with the comparison SQL.
QUERY_ONE = "thanedble"
QUERY_AND = "thon Thor than"
QUERY_PHRASE = "of_the thon"
QUERY_COMMON = "the ther"
QUERY_STEMS = "thanedble erings"
QUERY_HYBRID = "thanedble erin"
SOURCES = ("src1", "src4", "src7")
SINCE, UNTIL = "2024-03-07", "2024-09-20"
QUERY_VECTOR = [round(math.sin(i + 1), 4) for i in range(64)]
CODE_VECTOR = [round(math.cos(2 * i + 1), 4) for i in range(64)]
SEEDS = entities.Seeds(persons=("Customer#000000001", "customer#00000000", "Supplier#000000003 "), orgs=("1-URGENT", "Medium", "2-high."))
ALIASES = entities.Aliases(
    alias_of={f"Customer.{i:09d}+x@{seg}.example.com": f"Person No. {i % 40}"
              for i in range(120) for seg in ("Building", "Machinery", "Household")},
    member_of={f"person no {i}": f"Org {i % 7} Ltd." for i in range(30)},
)
CARD_ENTITY = ("email", "supplier.000000003@suppliers.example.com")
EMBED_RULES = {f"src{i}": ("tables/*", "notes/1*") if i % 2 else () for i in range(12)}
MODELS = {"prose": "voyage-3.5", "code": "voyage-code-3"}
TOP_N = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def published(col: Column | str) -> Column:
    return F.round(col, DIGITS)


# --- corpora derived from the tables ------------------------------------------


def doc_date(doc_id: Column) -> Column:
    month = F.lpad((doc_id % 12 + 1).cast("string"), 2, "0")
    day = F.lpad((doc_id % 28 + 1).cast("string"), 2, "0")
    return F.concat(F.lit("2024-"), month, F.lit("-"), day, F.lit("T08:30:00+00:00"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a plain-text file."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d, "source", F.concat(F.lit("notes/"), d, F.lit(".txt")).alias("path"),
        doc_date(d).alias("doc_date"), "text",
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a path whose suffix decides how it is treated."""
    d, kind = F.col("doc_id"), F.col("doc_id") % 6
    path = (
        F.when(kind == 0, F.concat(F.lit("notes/"), d, F.lit(".txt")))
        .when(kind == 1, F.concat(F.lit("notes/"), d, F.lit(".MD")))
        .when(kind == 2, F.concat(F.lit("src/deep/"), d, F.lit(".py")))
        .when(kind == 3, F.concat(F.lit("tables/"), d, F.lit(".csv")))
        .when(kind == 4, F.concat(F.lit("bin/."), d))
        .otherwise(F.concat(F.lit("commit/"), F.sha2(d.cast("string"), 256)))
    )
    return table(spark, sf_dir, "documents").select(d, "source", path.alias("path"), doc_date(d).alias("doc_date"), "text")


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(corpus(spark, sf_dir))
    split = chunking.chunk_prose(docs, F.col("text"))
    return chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path")))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: ``doc_id, source, path, title, doc_date, from, to``."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    receiver = F.concat(
        "s_name", F.lit(" <"), F.lower(F.translate("s_name", "#", ".")),
        F.lit("@suppliers.example.com>"),
    )
    to = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(receiver)), ", ").alias("to")
    )
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    sender = F.concat(
        shown, F.lit(" <"), F.translate("c_name", "#", "."), F.lit("+"),
        F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("@"), "c_mktsegment", F.lit(".example.com>"),
    )
    day = F.date_format("o_orderdate", "yyyy/M/d/")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        to, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        F.col("o_orderkey").alias("doc_id"),
        F.lit("mail").alias("source"),
        F.concat(day, "o_orderkey", F.lit(".eml")).alias("path"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("doc_date"),
        sender.alias("from"),
        "to",
    )


def mail_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.mail_occurrences(mail(spark, sf_dir), ("from", "to"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that quote the turn before them, as mail replies do."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.concat(F.lit("> "), F.regexp_replace("prev", "\n", "\n> "))
    body = (
        F.when(F.col("prev").isNull(), F.col("text"))
        .when(F.col("turn") % 3 == 2, F.concat("text", F.lit("\n\n\n\n"), quoted, F.lit("\n\nregards")))
        .otherwise(F.concat("text", F.lit("\n\nOn "), "turn", F.lit(" May 2024, someone WROTE:\n\n"), quoted))
    )
    return turns.withColumn("prev", before).select("conv_id", "turn", body.alias("body"))


# --- full text ------------------------------------------------------------------


def _lexical(query: str, analyser: str = "simple", keep=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(corpus(spark, sf_dir))
        hits = lexical.search_texts(docs, "text", query, ["doc_id"], analyser=analyser, keep=keep and keep())
        return hits.select("doc_id", "source", published("score").alias("score"))

    return run


def _in_scope() -> Column:
    return F.col("source").isin(*SOURCES) & (F.col("doc_date") >= SINCE) & (F.col("doc_date") <= UNTIL)


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document holding all phrases, with its counts."""
    phrases = analysis.query_phrases(QUERY_PHRASE, "simple")
    docs = spread(corpus(spark, sf_dir)).select("doc_id", "text")
    found = lexical.index_matches(lexical.build_postings(docs, analyser="simple"), phrases, ["doc_id"])
    return found.where("tf[0] > 0 AND tf[1] > 0").select(
        "doc_id", F.col("tf")[0].cast("long").alias("tf_phrase"), F.col("tf")[1].cast("long").alias("tf_word")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(corpus(spark, sf_dir)).select("doc_id", "text")
    return lexical.build_postings(docs, analyser="simple").select(
        "doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"),
        F.col("positions")[0].cast("long").alias("first_position"),
    )


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(corpus(spark, sf_dir).select("doc_id", "text"))
    lengths = docs.select(analysis.word_count(F.col("text"), "simple").alias("dl"))
    return lengths.agg(
        F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"), published(F.avg("dl")).alias("avgdl")
    )


def porter_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every distinct folded word."""
    docs = spread(corpus(spark, sf_dir).select("text"))
    vocabulary = docs.select(F.explode(analysis.words(F.col("text"), "folded")).alias("word")).distinct()
    return vocabulary.select("word", analysis.stem_words(F.array("word"))[0].alias("stem"))


def lexical_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each top hit; only the winners' texts are looked at again."""
    docs = spread(corpus(spark, sf_dir))
    hits = lexical.search_texts(docs, "text", QUERY_ONE, ["doc_id"], analyser="simple").select("doc_id")
    texts = corpus(spark, sf_dir).select("doc_id", "text").join(F.broadcast(hits), "doc_id")  # 50 hits
    phrases = analysis.query_phrases(QUERY_ONE, "simple")
    return texts.select("doc_id", snippet(F.col("text"), phrases, "simple").alias("snippet"))


def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from postings instead of texts, over chunks."""
    phrases = analysis.query_phrases(QUERY_AND, "simple")
    chunks = corpus_chunks(spark, sf_dir).select("doc_id", "seq", "text")
    rows = stored(lexical.build_postings(chunks, analyser="simple"))
    matches = lexical.index_matches(rows, phrases, ["doc_id", "seq"])
    lengths = chunks.select(analysis.word_count(F.col("text"), "simple").alias("dl")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")
    )
    df = lexical.index_frequencies(rows, phrases, ["doc_id", "seq"])
    stats = lengths.withColumn("df", df.scalar())
    hits = lexical.rank_bm25(matches, stats, len(phrases), ["doc_id", "seq"])
    return hits.select("doc_id", F.col("seq").cast("long").alias("seq"), published("score").alias("score"))


# --- vectors and fusion -----------------------------------------------------------


def _nearest(spark: SparkSession, sf_dir: str, query: list[float], where: Column | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.knn(rows if where is None else rows.where(where), query, ["vec_id"])


def knn_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, QUERY_VECTOR).select("vec_id", published("distance").alias("distance"))


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters apply after the top list is taken, so fewer than 50 may remain."""
    near = _nearest(spark, sf_dir, QUERY_VECTOR).withColumnRenamed("vec_id", "doc_id")
    kept = corpus(spark, sf_dir).where(F.col("doc_date") <= UNTIL).select("doc_id", "source")
    return kept.join(near, "doc_id").select("doc_id", "source", published("distance").alias("distance"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks scored by the lexical list and two vector spaces (even labels prose, odd code)."""
    chunks = corpus_chunks(spark, sf_dir)
    words = lexical.search_texts(
        chunks.select("doc_id", "seq", "text"), "text", QUERY_HYBRID, ["doc_id", "seq"], analyser="simple"
    )
    keys = ["doc_id", "seq"]
    lists = [fusion.ranked(words, keys, [F.round("score", lexical.ORDER_DIGITS).desc(), F.col("doc_id"), F.col("seq")])]
    known = corpus(spark, sf_dir).select("doc_id")
    for query, parity in ((QUERY_VECTOR, 0), (CODE_VECTOR, 1)):
        near = _nearest(spark, sf_dir, query, F.col("label") % 2 == parity).select(
            F.col("vec_id").alias("doc_id"), F.lit(0).alias("seq"), "distance"
        )
        kept = known.join(near, "doc_id")
        lists.append(fusion.ranked(kept, keys, [F.round("distance", lexical.ORDER_DIGITS), F.col("doc_id")]))
    return fusion.rrf(lists, keys)


def rrf_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(
        "doc_id", F.col("seq").cast("long").alias("seq"), published("score").alias("score")
    )


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 + two vector spaces, fused, collapsed to documents, best ten."""
    best = fusion.best_per_document(_fused(spark, sf_dir), ["doc_id"])
    best = best.select("doc_id", F.col("seq").alias("best_seq"), "score")
    # At most 150 winners: only their documents are read in full and chunked again.
    docs = corpus(spark, sf_dir).join(F.broadcast(best), "doc_id")
    split = chunking.chunk_prose(docs, F.col("text"))
    chunks = chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path")))
    hits = fusion.top_hits(chunks.where(F.col("seq") == F.col("best_seq")), 10)
    return hits.select(
        "source", "path", "doc_date", published("score").alias("score"),
        tx.excerpt(F.col("text")).alias("excerpt"), F.col("seq").cast("long").alias("chunk_seq"),
    )


def best_chunk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best chunk for one word."""
    words = lexical.search_texts(
        corpus_chunks(spark, sf_dir).select("doc_id", "seq", "text"), "text", QUERY_COMMON,
        ["doc_id", "seq"], analyser="simple", limit=None,
    )
    rounded = words.select("doc_id", "seq", F.round("score", lexical.ORDER_DIGITS).alias("score"))
    best = fusion.best_per_document(rounded, ["doc_id"])
    return best.select("doc_id", F.col("seq").cast("long").alias("seq"), published("score").alias("score"))


def source_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where(_in_scope()).select("doc_id", "source", "doc_date")


def window_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


# --- chunking ----------------------------------------------------------------------


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("text_hash"))


def chunk_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(corpus_chunks(spark, sf_dir))


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose packing with overlap: every line of a document made a paragraph."""
    docs = spread(corpus(spark, sf_dir))
    split = chunking.chunk_prose(docs, F.regexp_replace("text", "\n", "\n \n"), target_tokens=250, overlap_tokens=40)
    return _chunk_rows(chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path"))))


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines starting with A to F made headings."""
    docs = spread(corpus(spark, sf_dir))
    text = F.regexp_replace(F.regexp_replace("text", "\n", "\n\n"), "\n([A-F])", "\n## $1")
    split = chunking.chunk_prose(docs, text, markdown=True, target_tokens=250, overlap_tokens=40)
    return _chunk_rows(chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path"))))


def chunk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as tables: the first line is the header row of every chunk."""
    docs = spread(corpus(spark, sf_dir))
    split = chunking.chunk_csv(docs, F.col("text"), target_tokens=250, overlap_tokens=40)
    return _chunk_rows(chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path"))))


def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences after the first of a line indented, so that lines become blocks."""
    docs = spread(corpus(spark, sf_dir))
    split = chunking.chunk_code(docs, F.regexp_replace("text", r"\. ", ".\n    "), target_tokens=250)
    return _chunk_rows(chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path"))))


def chunk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the message of a commit."""
    path = F.concat(F.lit("commit/"), F.sha2(F.col("doc_id").cast("string"), 256))
    docs = corpus(spark, sf_dir).withColumn("path", path)
    split = chunking.chunk_whole(docs, F.col("text"))
    sha = F.substring_index("path", "/", -1)
    header = headers.commit_header(F.col("source"), sha, F.lit(None), F.col("doc_date"))
    return _chunk_rows(chunking.explode_chunks(split, header))


def chunk_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the layout its path asks for, all in one pass."""
    path = F.col("path")
    docs = spread(routed(spark, sf_dir)).withColumn("layout", chunking.layout_for(F.lit("filetree"), path))
    sha = F.substring_index("path", "/", -1)
    commit = headers.commit_header(F.col("source"), sha, F.lit(None), F.col("doc_date"))
    header = F.when(tx.is_commit(path), commit).otherwise(headers.file_header(F.col("source"), path))
    return _chunk_rows(chunking.chunk_by_layout(docs.withColumn("header", header), F.col("header")))


def doc_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = chunking.reconstruct(corpus_chunks(spark, sf_dir).select("doc_id", "seq", "text"))
    return whole.select("doc_id", F.sha2("content", 256).alias("content_hash"))


def doc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, truncated = tx.clip(F.col("text"), 2000)
    return corpus(spark, sf_dir).select("doc_id", F.sha2(cut, 256).alias("content_hash"), truncated.alias("truncated"))


# --- extraction ----------------------------------------------------------------------


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", markup.html_to_text(F.col("html")).alias("text"))


def quoted_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", tx.strip_quoted_history(F.col("body")).alias("body"))


def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix handling, model routing, size and hash per document."""
    path, text = F.col("path"), F.col("text")
    raw = text.cast("binary")
    return routed(spark, sf_dir).select(
        "doc_id", tx.suffix(path).alias("suffix"), tx.handling(path).alias("handling"),
        tx.model_kind(path).alias("kind"), chunking.layout_for(F.lit("filetree"), path).alias("layout"),
        F.sha2(raw, 256).alias("content_hash"), F.octet_length(raw).cast("long").alias("bytes"),
        tx.looks_binary(raw).alias("is_binary"), tx.estimated_tokens(text).alias("tokens"),
    )


def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text re-encoded as ISO-8859-1 bytes, then decoded with the fallback."""
    latin = F.encode(F.regexp_replace("text", r"[^\x{1}-\x{ff}]", "?"), "ISO-8859-1")
    return corpus(spark, sf_dir).select("doc_id", F.sha2(tx.decode_bytes(latin), 256).alias("text_hash"))


def decode_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in one-byte charsets with the name of one that fits, one that is another's, one that does not exist, or none."""
    lang = F.coalesce("lang", F.lit(""))
    declared = F.when(lang == "fr", "iso-8859-15").when(lang == "de", "cp1252").when(lang == "es", "no-such-charset")
    text = F.translate(F.regexp_replace("text", r"[^\x{1}-\x{ff}]", "?"), "éèü", "½¤\x80")
    raw = F.encode(text, "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.decode_declared(raw, declared), 256).alias("text_hash"))


def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header line and searchable header block of every message."""
    none = F.lit(None).cast("string")
    meta = F.struct(
        F.col("from"), F.col("to"), none.alias("cc"), none.alias("bcc"), none.alias("reply_to"),
        F.array(F.lit("INBOX"), F.concat(F.lit("P"), F.substring_index("title", " ", -1))).alias("labels"),
    )
    rows = mail(spark, sf_dir).withColumn("meta", meta)
    title, date = F.col("title"), F.col("doc_date")
    return rows.select(
        "doc_id", headers.mail_header(title, F.col("from"), date).alias("header"),
        F.sha2(headers.mail_block(F.col("meta"), title, date), 256).alias("block_hash"),
    )


# --- entities ----------------------------------------------------------------------------


def email_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_found(spark, sf_dir).select("doc_id", "key", "rel", "display", F.col("at.n").cast("long").alias("n"))


def address_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' addresses given as objects with either key, as header strings, and mixed in one list."""
    mailbox = F.concat(F.translate("c_name", "#", "."), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    header = F.concat(F.lit('"'), "c_mktsegment", F.lit(', desk" <desk@'), F.lower("c_mktsegment"), F.lit(".example.com>"))
    quoted = F.regexp_replace(header, '"', r'\\"')
    text = F.concat(
        F.lit('[{"email": "'), mailbox, F.lit('", "display": "'), "c_name", F.lit('"}, "'), quoted,
        F.lit('", {"name": "nobody"}, 7, {"address": " a.'), mailbox, F.lit('", "name": ""}]'))
    docs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.lit("mail").alias("source"), F.lit("").alias("path"), F.parse_json(text).alias("to"))
    return entities.mail_occurrences(docs, ("to",)).select("doc_id", "key", "display", F.col("at.n").cast("long").alias("n"))


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.document_edges(mail_found(spark, sf_dir))


def display_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = entities.entities(entities.name_votes(mail_found(spark, sf_dir)))
    return known.select("kind", "key", "display")


def slug_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person names of customers and brand lines of parts as slugs."""
    people = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("  ("), "c_mktsegment", F.lit(")")).alias("name"))
    brands = table(spark, sf_dir, "part").select(F.concat_ws(" / ", "p_brand", "p_name", "p_type").alias("name"))
    return people.unionByName(brands).select("name", addresses.slug(F.col("name")).alias("slug"))


def category_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^/]*//[^/]*/(.*)$", 1)
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit("web").alias("source"), path.alias("path")
    )
    return entities.category_occurrences(pages).select("doc_id", "key", "display")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mail(spark, sf_dir).withColumn("title", F.concat_ws(" ", "title", "from"))
    return entities.mention_occurrences(docs, SEEDS).select("doc_id", "kind", "key", "display")


def mentions_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is named in a message's title, sender and receivers, with every customer and supplier as a seed."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.lit("person").alias("kind"), F.col("c_name").alias("name"))
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.lit("org").alias("kind"), F.col("s_name").alias("name"))
    docs = mail(spark, sf_dir).withColumn("title", F.concat_ws(" ", "title", "from", "to"))
    found = entities.mentions_in_table(docs, people.unionByName(firms))
    return found.select("doc_id", "kind", "key", "display")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, links, known entities) of the mail archive with aliases applied."""
    found = stored(mail_found(spark, sf_dir))
    votes = entities.name_votes(found)
    links, extra = entities.linked(votes, ALIASES)
    return entities.document_edges(found), links, entities.entities(votes.unionByName(extra))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = _graph(spark, sf_dir)
    return links.select(
        F.concat_ws(":", "a_kind", "a_key").alias("a"), "rel", F.concat_ws(":", "b_kind", "b_key").alias("b")
    )


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who answers to a key, best kind first."""
    return entities.find(_graph(spark, sf_dir)[2], "person no 5")


def entity_card_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of one person's links."""
    _, links, known = _graph(spark, sf_dir)
    return entities.directed_links(links, known, "person", "person no 5")


def entity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, known = _graph(spark, sf_dir)
    return entities.neighbours(links, known, "person", "person no 5")


def entity_card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = stored(mail(spark, sf_dir))
    edges = entities.document_edges(entities.mail_occurrences(messages, ("from", "to")))
    kind, key = CARD_ENTITY
    docs = messages.select("doc_id", "source", "path", "title", "doc_date")
    return entities.newest_documents(edges, docs, kind, key)


def alias_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondents of the archive, with customers of finished orders as commit authors."""
    messages = stored(mail(spark, sf_dir).select("doc_id", "source", "path", "from", "to"))
    commits = messages.where("doc_id % 5 = 0").select(
        "doc_id", F.lit("repo").alias("source"), "path",
        F.regexp_extract("from", "<([^>]*)>", 1).alias("email"), F.regexp_extract("from", "^(.*) <", 1).alias("name"),
    )
    found = stored(entities.mail_occurrences(messages, ("from", "to")).unionByName(
        entities.person_occurrences(commits, "author", "email", "name", 0)
    ))
    known = entities.entities(entities.name_votes(found))
    return entities.alias_review(entities.document_edges(found), known, TOP_N)


# --- index maintenance ----------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(what the source holds now, what was stored) for every document."""
    docs = routed(spark, sf_dir)
    d = F.col("doc_id")
    stat = F.concat_ws(":", (d * 1000).cast("string"), F.length("text").cast("string"))
    sha = F.sha2("text", 256)
    git = tx.is_commit(F.col("path"))
    probes = docs.where(d % 10 != 3).select(
        "source", "path",
        F.when(~git, F.when(d % 4 == 0, F.concat(stat, F.lit("0"))).otherwise(stat)).alias("stat_sig"),
        F.when(git, F.when(d % 9 == 0, F.reverse(sha)).otherwise(sha)).alias("git_sha"),
    )
    stored = docs.where(d % 7 != 2).select(
        "source", "path", F.when(~git, stat).alias("stat_sig"), sha.alias("content_hash"), "doc_id"
    )
    return probes, stored


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*_snapshots(spark, sf_dir)).select("source", "path", "change")


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.counts(changes.diff(*_snapshots(spark, sf_dir)))


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left once the vanished documents are gone."""
    gone = changes.diff(*_snapshots(spark, sf_dir)).where("change = 'deleted'").select("doc_id")
    left = corpus_chunks(spark, sf_dir).join(gone, "doc_id", "left_anti")
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("seq"))


def _routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = chunking.chunk_prose(spread(routed(spark, sf_dir)), F.col("text"))
    return chunking.explode_chunks(split, headers.file_header(F.col("source"), F.col("path")))


def embed_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = embedding.eligible(_routed_chunks(spark, sf_dir), _embedded(spark, sf_dir), EMBED_RULES, ["doc_id", "seq"])
    return queue.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind", "tokens")


def embed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = embedding.eligible(_routed_chunks(spark, sf_dir), _embedded(spark, sf_dir), EMBED_RULES, ["doc_id", "seq"])
    costs = embedding.plan(queue, MODELS)
    return costs.withColumn("cost_usd", published("cost_usd"))


def stats_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus_chunks(spark, sf_dir).select("doc_id", "seq")
    names = [f"src{i}" for i in range(0, 24, 2)]
    return documents.source_stats(corpus(spark, sf_dir), chunks, _embedded(spark, sf_dir), names)


# --- the stored index ---------------------------------------------------------------------------


ADDED_LANG, CHANGED_LANG, DELETED_LANG, DRAFT_CHARS = "es", "de", "fr", 500
INDEX_SEEDS = entities.Seeds(persons=("Src1", "src12/"), orgs=("SRC7", "rc1"))
_stored: dict[tuple[str, str], tuple[Index, list[Outcome]]] = {}


def versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """What a source holds at first and later: drafts of some documents, some not yet there, some there no longer."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), doc_date(F.col("doc_id")).alias("doc_date"),
        F.coalesce("lang", F.lit("")).alias("lang"), "text")
    draft = F.when(F.col("lang") == CHANGED_LANG, F.substring("text", 1, DRAFT_CHARS)).otherwise(F.col("text"))
    return [docs.where(F.col("lang") != ADDED_LANG).withColumn("text", draft), docs.where(F.col("lang") != DELETED_LANG)]


def stored_index(spark: SparkSession, sf_dir: str) -> tuple[Index, list[Outcome]]:
    """An index in the shared folder that has seen both versions, merged into one part; and what the updates did.

    Built once for all queries of an application.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _stored:
        index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        source = Source("corpus", "filetree", sf_dir)
        outcomes = [
            update_source(index, source, INDEX_SEEDS, entities.Aliases(), probes=table_probes(docs, source), loader=table_loader(docs))
            for docs in versions(spark, sf_dir)]
        merge_parts(index, entities.Aliases(), full=True)
        index.clean()
        _stored[known] = index, outcomes
    return _stored[known]


def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each update found and wrote."""
    _, outcomes = stored_index(spark, sf_dir)
    return spark.createDataFrame(
        [(n, o.added, o.changed, o.deleted, o.unchanged, o.chunks) for n, o in enumerate(outcomes, 1)],
        "step long, added long, changed long, deleted long, unchanged long, chunks long")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = stored_index(spark, sf_dir)
    return index.of_source("documents", "corpus").select("path", "title", "doc_date", "bytes", "content_hash", F.sha2("text", 256).alias("text_hash"))


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = stored_index(spark, sf_dir)
    return index.live("chunks").select(
        "path", F.col("seq").cast("long").alias("seq"), F.col("words").cast("long").alias("words"), F.sha2("text", 256).alias("text_hash"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = stored_index(spark, sf_dir)
    return index.live("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all matching chunks from stored postings; the collection's size comes from the snapshot."""
    index, _ = stored_index(spark, sf_dir)
    phrases = analysis.query_phrases(QUERY_STEMS)
    scored = searching.lexical_scores(index, phrases, None, limit=None)
    paths = index.read("documents").select("batch", "doc_id", "path")
    return scored.join(paths, ["batch", "doc_id"]).select("path", F.col("seq").cast("long").alias("seq"), published("score").alias("score"))


def index_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per entity, with the name it is shown by."""
    index, _ = stored_index(spark, sf_dir)
    counted = index.live("occurrences").groupBy("kind", "key", "rel").agg(F.count_distinct("batch", "doc_id").alias("documents"))
    return counted.join(entities.entities(index.read("names")), ["kind", "key"]).select("kind", "key", "rel", "display", "documents")


class LetterCounts:
    """An embedding client that needs no network: a text's vector is how often it has each letter."""

    def embed(self, texts: list[str], model: str, input_type: str) -> LetterCounts:
        self.embeddings = [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
        return self


class IndexModels:
    models, embed_rules = MODELS, {"corpus": ("src3/*", "src1*/*7.txt")}


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the chunks that may be embedded, after a drain."""
    index, _ = stored_index(spark, sf_dir)
    embedding_plan.drain(index, IndexModels, LetterCounts)
    paths = index.read("documents").select("batch", "doc_id", "path")
    return index.live("vectors").join(paths, ["batch", "doc_id"]).select(
        "path", F.col("seq").cast("long").alias("seq"), "kind", "tokens", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("letters"))


QUERIES = {
    "hybrid_search": hybrid_search,
    "lexical_bm25": _lexical(QUERY_ONE),
    "lexical_bm25_filtered": _lexical(QUERY_COMMON, keep=_in_scope),
    "lexical_multi_term_and": _lexical(QUERY_AND),
    "lexical_phrase_bm25": _lexical(QUERY_PHRASE),
    "porter_bm25": _lexical(QUERY_STEMS, "porter"),
    "porter_stems": porter_stems,
    "lexical_snippets": lexical_snippets,
    "indexed_bm25": indexed_bm25,
    "phrase_match": phrase_match,
    "postings": postings,
    "term_frequencies": term_frequencies,
    "corpus_stats": corpus_stats,
    "knn_top50": knn_top50,
    "knn_postfilter": knn_postfilter,
    "rrf_three_lists": rrf_three_lists,
    "best_chunk_per_doc": best_chunk_per_doc,
    "source_date_filter": source_date_filter,
    "window_excerpt": window_excerpt,
    "chunk_prose": chunk_prose,
    "chunk_paragraphs": chunk_paragraphs,
    "chunk_markdown": chunk_markdown,
    "chunk_csv": chunk_csv,
    "chunk_code": chunk_code,
    "chunk_routed": chunk_routed,
    "chunk_whole": chunk_whole,
    "doc_reconstruct": doc_reconstruct,
    "doc_truncate": doc_truncate,
    "html_to_text": html_to_text,
    "quoted_strip": quoted_strip,
    "content_gate": content_gate,
    "decode_fallback": decode_fallback,
    "decode_charsets": decode_charsets,
    "mail_headers": mail_headers,
    "email_occurrences": email_occurrences,
    "address_items": address_items,
    "document_edges": document_edges,
    "display_most_frequent": display_most_frequent,
    "slug_normalize": slug_normalize,
    "category_from_path": category_from_path,
    "mentions": mentions,
    "entity_links": entity_links,
    "entity_lookup": entity_lookup,
    "entity_card_links": entity_card_links,
    "entity_neighbours": entity_neighbours,
    "entity_card_documents": entity_card_documents,
    "alias_review": alias_review,
    "snapshot_diff": snapshot_diff,
    "change_counts": change_counts,
    "delete_cascade": delete_cascade,
    "embed_eligible": embed_eligible,
    "embed_plan": embed_plan,
    "stats_per_source": stats_per_source,
    "mentions_of_all": mentions_of_all,
    "index_updates": index_updates,
    "index_documents": index_documents,
    "index_chunks": index_chunks,
    "index_terms": index_terms,
    "index_bm25": index_bm25,
    "index_entities": index_entities,
    "index_vectors": index_vectors,
}
