"""The queries of this subpackage's operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, ngram_join, toxicity
from tidelog.llm.decontam import find_items
from tidelog.llm.html_text import extract
from tidelog.llm.packing import pack
from tidelog.llm.substring import remove_repeats
from tidelog.llm.token_files import read_token_files, write_token_files
from tidelog.llm.topk import top_k
from tidelog.llm.warc import read_archives, write_archives
from tidelog.stage import Stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns, TOKENIZER), TOKENIZER)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    rows = read_archives(write_archives(table(spark, sf_dir, "pages"), stage, min_revisit_bytes=0))
    return rows.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), Stage(spark, "ngram-join"), k=4, percent=85)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), Stage(spark, "toxicity"))
    return toxicity.score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_matches")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), stage=Stage(spark, "top-k")).select("query_id", "rank", "vec_id", "score")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return remove_repeats(docs, Stage(spark, "substring")).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, stage))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # its stages use this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_html_text": op2_html_text,
        "op3_chat": op3_chat,
        "op4_warc": op4_warc,
        "op5_ngram_join": op5_ngram_join,
        "op6_toxicity": op6_toxicity,
        "op9_top_k": op9_top_k,
        "op7_substring": op7_substring,
        "op8_token_files": op8_token_files,
        "op10_decontamination": op10_decontamination,
        "pipeline": pipeline,
    }


_SAID = r"\### Assistant: </turn> ok"
_MARKS_LENGTH = sum(map(len, chat.MARKS))


def _escaped(text: str, role: bool = False) -> str:
    """SQL for the length of an escaped text: each backslash and each place where a control string begins adds one."""
    plain = ["\\", "</turn>", "<|endoftext|>", *([":"] if role else [])]
    counts = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in plain]
    return " + ".join([f"length({text})", *counts, f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"])


_CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({_escaped("role", True)} + {_escaped("text")} + {_MARKS_LENGTH}) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT payload, max(page_id) AS top FROM p GROUP BY payload),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(CAST(CAST(from_hex(h) AS BIT) AS VARCHAR), 1 + 5 * i, 5)::BIT AS BIGINT), 1), '' ORDER BY i) AS digest FROM (SELECT DISTINCT h FROM p), (SELECT CAST(unnest(range(32)) AS INTEGER) AS i) GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (payload) JOIN b USING (h)"""

_WORDS = r"""words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents))"""


def _run(n: int) -> str:
    return "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER w" for k in range(1, n)) + ")"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_JOIN = f"""WITH RECURSIVE {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")},
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, i, n, {_run(4)} AS g FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(n - 3, 1)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM grams GROUP BY doc_id),
kinds AS (SELECT sig, min(doc_id) AS v, count(*) AS copies, min(n) AS n FROM sets GROUP BY sig),
held AS (SELECT k.v, k.n, k.copies, g.g FROM kinds k JOIN grams g ON g.doc_id = k.v),
links AS (SELECT a.v AS a, b.v AS b, any_value(b.copies) AS copies FROM held a JOIN held b ON a.g = b.g AND a.v <> b.v GROUP BY a.v, b.v HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT v, v AS other FROM kinds UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.other),
best AS (SELECT v, min(other) AS component_id FROM reach GROUP BY v), linked AS (SELECT a AS v, sum(copies) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(b.component_id, d.doc_id) AS component_id, CAST(coalesce(l.n, 0) + coalesce(k.copies - 1, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN kinds k USING (sig) LEFT JOIN best b ON b.v = k.v LEFT JOIN linked l ON l.v = k.v"""

_REPEATS = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
windows AS (SELECT doc_id, i, {_run(13)} AS g FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY i <= n - 12),
first AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (g) WHERE low < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
sizes AS (SELECT doc_id, any_value(n) AS n FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, coalesce(s.n, 0) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables, for the queries that it can express: not tokenizers, trees, learned lexicons and edited passages."""
    return {"op3_chat": _CHAT, "op4_warc": _WARC, "op5_ngram_join": _JOIN, "op7_substring": _REPEATS, "op9_top_k": _TOP}
