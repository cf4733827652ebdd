"""Queries of curation, deduplication, retrieval, tokens and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill import streaming
from lakemill.functions import text as tx
from lakemill.operators import components, dedup, media, search, tokens, vectors
from lakemill.operators.store import scratch
from lakemill.plans.registry import query

# RE2 knows white space of ASCII alone; the tables hold no other
_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def sql_round(name: str, digits: int = 6) -> Column:
    """Rounded as DuckDB does, by a product of doubles; ``F.round`` goes by decimal digits and differs where those end in a five."""
    return (F.round(F.col(name) * 10.0**digits) / 10.0**digits).alias(name)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("normalize_text", f"SELECT doc_id, {_NORM} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.normalize_text(docs(spark, sf_dir)).select("doc_id", "text")


@query("content_hash", f"SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.add_content_hash(docs(spark, sf_dir)).select("doc_id", "content_hash")


@query("exact_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(docs(spark, sf_dir), "doc_id").select("doc_id")


@query("shingles", f"SELECT doc_id, count(*) AS n, min(g) AS first_gram FROM (SELECT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, list_transform({_WORDS}, lambda w: lower(w)) AS ws FROM documents), unnest(range(1, greatest(len(ws) - 3, 0) + 2)) AS t(i) WHERE len(ws) > 0) GROUP BY doc_id")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted inside each row; grams never leave it."""
    counted = tx.let(tx.shingles(F.col("text"), 3), lambda g: F.struct(F.greatest(F.size(g), F.lit(0)).alias("n"), F.array_min(g).alias("g")))
    found = docs(spark, sf_dir).select("doc_id", counted.alias("x")).groupBy("doc_id").agg(F.sum("x.n").alias("n"), F.min("x.g").alias("first_gram"))
    return found.where("n > 0")


@query("chunk_chars", "SELECT doc_id, i::INTEGER AS chunk_index, substr(text, i * 400 + 1, 500) AS chunk FROM documents, unnest(range(0, greatest(ceil((length(text) - 500) / 400.0), 0)::BIGINT + 1)) AS t(i) WHERE length(text) > 0")
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunk_chars(docs(spark, sf_dir), chunk_chars=500, overlap=100).select("doc_id", "chunk_index", "chunk")


@query("chunk_recursive", r"""
WITH packed AS (SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] ELSE string_split(list_reduce(list_filter(string_split(text, ' '), lambda w: w <> ''),
  lambda acc, w: acc || CASE WHEN length(acc) - coalesce(length(regexp_extract(acc, '^(?s:.*)\x01')), 0) + 1 + length(w) > 500 THEN chr(1) ELSE ' ' END || w), chr(1)) END AS cs FROM documents WHERE trim(text) <> '')
SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS chunk_index, unnest(cs) AS chunk FROM packed""")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunk_text(docs(spark, sf_dir), chunk_chars_=500, separators=[" "]).select("doc_id", "chunk_index", "chunk")


@query("chunk_separators")
def chunk_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunk_text(docs(spark, sf_dir), chunk_chars_=500).select("doc_id", "chunk_index", "chunk")


_STOPS = "'the','be','to','of','and','a','in','that','have','i','it','for','not','on','with','he','as','you','do','at','this','but','his','by','from','they','we','say','her','she','or','an','will','my','one','all','would','there','their'"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE {part}::DOUBLE / {whole} END"


_SIGNALS = rf"""
base AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS ws,
  CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) END AS ls FROM documents),
counted AS (SELECT doc_id, t, ws, ls, length(t) AS nc, len(ws) AS nw, len(ls) AS nl, length(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{Nl}}]', '', 'g')) AS na, length(regexp_replace(t, '[^0-9]', '', 'g')) AS nd, length(regexp_replace(t, '[^\s]', '', 'g')) AS ns,
  list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM base),
signals AS (SELECT doc_id, nc AS char_count, nw AS word_count, {_share("list_sum(list_transform(ws, lambda w: length(w)))", "nw")} AS mean_word_len, {_share("na", "nc")} AS alpha_ratio, {_share("nd", "nc")} AS digit_ratio, {_share("(nc - na - nd - ns)", "nc")} AS symbol_ratio,
  {_share("len(list_filter(ws, lambda w: regexp_matches(w, '[' || chr(92) || 'p{{L}}' || chr(92) || 'p{{M}}' || chr(92) || 'p{{Nl}}]')))".replace("{{", "{").replace("}}", "}"), "nw")} AS alpha_word_ratio, {_share("(nl - len(list_distinct(ls)))", "nl")} AS dup_line_ratio, {_share("len(list_filter(ls, lambda x: x[1] = '#'))", "nl")} AS hash_line_ratio,
  {_share("(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(ws) AS w) GROUP BY w))", "nw")} AS top_word_ratio, {_share(f"len(list_filter(ws, lambda w: lower(w) IN ({_STOPS})))", "nw")} AS stopword_ratio,
  {_share("(len(gs) - len(list_distinct(gs)))", "len(gs)")} AS dup_ngram_ratio FROM counted)"""
_ROUNDED = ("mean_word_len", "alpha_ratio", "digit_ratio", "symbol_ratio", "alpha_word_ratio", "dup_line_ratio", "hash_line_ratio", "top_word_ratio", "stopword_ratio", "dup_ngram_ratio")
_REASON = """CASE WHEN word_count < 50 THEN 'too_few_words:' || word_count || '<50' WHEN word_count > 100000 THEN 'too_many_words:' || word_count || '>100000'
  WHEN mean_word_len < 3 THEN 'mean_word_len_low:' || format('{:.2f}', mean_word_len) WHEN mean_word_len > 10 THEN 'mean_word_len_high:' || format('{:.2f}', mean_word_len)
  WHEN symbol_ratio > 0.3 THEN 'symbol_ratio_high:' || format('{:.2f}', symbol_ratio) WHEN alpha_word_ratio < 0.6 THEN 'alpha_word_ratio_low:' || format('{:.2f}', alpha_word_ratio)
  WHEN dup_line_ratio > 0.3 THEN 'dup_line_ratio_high:' || format('{:.2f}', dup_line_ratio) WHEN top_word_ratio > 0.3 THEN 'top_word_ratio_high:' || format('{:.2f}', top_word_ratio)
  WHEN digit_ratio > 0.3 THEN 'digit_ratio_high:' || format('{:.2f}', digit_ratio) WHEN stopword_ratio < 0.06 THEN 'stopword_ratio_low:' || format('{:.3f}', stopword_ratio)
  WHEN dup_ngram_ratio > 0.3 THEN 'dup_ngram_ratio_high:' || format('{:.2f}', dup_ngram_ratio) END"""


@query("quality_signals", f"WITH {_SIGNALS} SELECT doc_id, char_count, word_count, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM signals")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tx.quality_signals(docs(spark, sf_dir), prefix="")
    return q.select("doc_id", "char_count", "word_count", *(sql_round(c) for c in _ROUNDED))


@query("quality_filter", f"WITH {_SIGNALS} SELECT doc_id FROM signals WHERE ({_REASON}) IS NULL")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.quality_filter(docs(spark, sf_dir)).select("doc_id")


@query("quality_reasons", f"WITH {_SIGNALS} SELECT doc_id, {_REASON} AS reason FROM signals")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.quality_filter(docs(spark, sf_dir), reason_column="reason").select("doc_id", "reason")


@query("quality_filter_limits", f"WITH {_SIGNALS} SELECT doc_id FROM signals WHERE word_count BETWEEN 20 AND 2000 AND mean_word_len BETWEEN 3 AND 8 AND symbol_ratio <= 0.1 AND alpha_word_ratio >= 0.6 AND dup_line_ratio <= 0.3 AND top_word_ratio <= 0.3 AND digit_ratio <= 0.3 AND stopword_ratio >= 0.06 AND dup_ngram_ratio <= 0.3")
def quality_filter_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.quality_filter(docs(spark, sf_dir), min_words=20, max_words=2000, max_mean_word_len=8.0, max_symbol_ratio=0.1).select("doc_id")


_SCRIPT = {
    "zh": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", "ja": r"\x{3040}-\x{30FF}", "ko": r"\x{AC00}-\x{D7AF}", "ru": r"\x{400}-\x{4FF}", "ar": r"\x{600}-\x{6FF}", "el": r"\x{370}-\x{3FF}", "hi": r"\x{900}-\x{97F}", "latin": "A-Za-z",
}  # fmt: skip
_VOTE = {
    "en": "the and of to in is that it for was with as", "es": "el la de que y en los las una por con para", "fr": "le la de et les des un une que pour dans est",
    "de": "der die und das den von mit ist nicht ein eine auch", "it": "il di che la il un per con non una sono gli", "pt": "de que os as um uma para com nao por dos das",
}  # fmt: skip
_LANG = rf"""
scripts AS (SELECT doc_id, {", ".join(f"length(regexp_replace(t, '[^{r}]', '', 'g')) AS s_{k}" for k, r in _SCRIPT.items())},
  list_distinct(list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{M}}\p{{Nl}}]', '', 'g'))), lambda w: w <> '')) AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
votes AS (SELECT doc_id, {" + ".join(f"s_{k}" for k in _SCRIPT)} AS letters, greatest({", ".join(f"s_{k}" for k in _SCRIPT)}) AS top, {", ".join(f"s_{k}" for k in _SCRIPT)},
  {", ".join(f"len(list_filter([{', '.join(repr(w) for w in v.split())}], lambda w: list_contains(ws, w))) AS v_{k}" for k, v in _VOTE.items())} FROM scripts),
languages AS (SELECT doc_id, CASE WHEN letters = 0 THEN 'und' {" ".join(f"WHEN s_{k} = top THEN '{k}'" for k in _SCRIPT if k != "latin")} {" ".join(f"WHEN v_{k} = greatest({', '.join(f'v_{x}' for x in _VOTE)}) THEN '{k}'" for k in _VOTE)} END AS lang,
  CASE WHEN letters = 0 THEN 0.0 WHEN s_latin < top THEN top::DOUBLE / letters ELSE coalesce(greatest({", ".join(f"v_{x}" for x in _VOTE)})::DOUBLE / nullif({" + ".join(f"v_{x}" for x in _VOTE)}, 0), 0.0) END AS lang_conf FROM votes)"""


@query("detect_language", f"WITH {_LANG} SELECT doc_id, lang, round(lang_conf, 6) AS lang_conf FROM languages")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.detect_language(docs(spark, sf_dir)).select("doc_id", "lang", sql_round("lang_conf"))


@query("language_filter", f"WITH {_LANG} SELECT doc_id FROM languages WHERE lang IN ('en', 'de') AND lang_conf >= 0.4")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.language_filter(docs(spark, sf_dir), keep=["en", "de"], min_confidence=0.4).select("doc_id")


_DIGIT = "list_transform(string_split(regexp_replace(d, '[^0-9]', '', 'g'), ''), lambda c: c::INTEGER)"
_LUHN = f"list_sum(list_transform(list_reverse({_DIGIT}), lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)) % 10 = 0"
_NUMBER = rf"""CASE WHEN regexp_full_match(d, '(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){{3}}') THEN '[IPV4]' WHEN n BETWEEN 13 AND 16 AND {_LUHN} THEN '[CREDIT_CARD]' WHEN n BETWEEN 10 AND 12 THEN '[PHONE]' WHEN n = 9 THEN '[SSN]' ELSE d END"""
# the text as pieces between the marks of addresses and numbers; the tables have no digits beside the marks of addresses
_PII = rf"""
marked AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]*[.][A-Za-z0-9.-]*', '[EMAIL]', 'g'), 'https?://[^ 	

]*', '[URL]', 'g') AS t FROM documents),
pieces AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '[^0-9]+|[0-9][0-9.() -]*[0-9]|[0-9]')) AS d, generate_subscripts(regexp_extract_all(t, '[^0-9]+|[0-9][0-9.() -]*[0-9]|[0-9]'), 1) AS i FROM marked),
judged AS (SELECT doc_id, i, d, CASE WHEN regexp_matches(d, '^[0-9]') THEN (SELECT {_NUMBER} FROM (SELECT length(regexp_replace(d, '[^0-9]', '', 'g')) AS n)) ELSE d END AS x FROM pieces),
redacted AS (SELECT m.doc_id, coalesce(string_agg(x, '' ORDER BY i), '') AS redacted FROM marked m LEFT JOIN judged j ON m.doc_id = j.doc_id GROUP BY m.doc_id)"""


@query("redact_pii", f"WITH {_PII} SELECT doc_id, redacted FROM redacted")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.redact_pii(docs(spark, sf_dir), out_column="redacted").select("doc_id", "redacted")


@query("detect_pii", rf"WITH {_PII} SELECT doc_id, len(regexp_extract_all(redacted, '\[(EMAIL|URL|IPV4|CREDIT_CARD|PHONE|SSN)\]'))::INTEGER AS pii_count FROM redacted")
def detect_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.detect_pii(docs(spark, sf_dir)).select("doc_id", "pii_count")


_MARKS = " AND ".join(f"NOT contains(lower(x), '{m}')" for m in ("javascript", "lorem ipsum", "terms of service", "terms of use", "privacy policy", "all rights reserved", "cookie", "read more", "click here", "sign up", "log in", "{", "}", "©"))


@query("c4_line_filter", rf"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3 AND regexp_matches(x, '[.!?"。！？]$') AND {_MARKS}), chr(10)), '') AS text FROM documents""")
def c4_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.c4_line_filter(docs(spark, sf_dir)).select("doc_id", "text")


@query("corpus_line_dedup", r"""
WITH ls AS (SELECT doc_id, i, line, trim(lower(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)),
bad AS (SELECT k FROM ls WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM bad)), '') AS text FROM documents d JOIN ls ON d.doc_id = ls.doc_id GROUP BY d.doc_id""")
def corpus_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.corpus_line_dedup(docs(spark, sf_dir), "doc_id").select("doc_id", "text")


@query("normalize_unicode", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.normalize_unicode(docs(spark, sf_dir)).select("doc_id", "text")


_SIGNS = " + ".join(f"(length({{x}}) - length(replace({{x}}, '{m}', ''))) / {len(m)}" for m in ("Ã", "Â", "â€", "Ð", "Ñ", "\ufffd"))


@query("fix_encoding", f"""
SELECT doc_id, CASE WHEN fixed IS NOT NULL AND {_SIGNS.format(x='fixed')} < {_SIGNS.format(x='text')} THEN fixed ELSE text END AS text FROM (
  SELECT doc_id, text, CASE WHEN {_SIGNS.format(x='text')} > 0 AND NOT regexp_matches(text, '[^\\x00-\\xFF]') THEN TRY(decode(unhex(array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02x', unicode(c))), '')))) END AS fixed FROM documents)""")
def fix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.fix_encoding(docs(spark, sf_dir)).select("doc_id", "text")


@query("token_length_filter", "SELECT doc_id FROM documents WHERE strlen(text) BETWEEN 100 AND 3000")
def token_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.token_length_filter(docs(spark, sf_dir), min_tokens=100, max_tokens=3000).select("doc_id")


_BARE = "html"
for _pattern, _with in ((r"(?s)<!--.*?-->", " "), (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?is)<noscript\b.*?</noscript\s*>", " "), (r"(?s)<[^>]*>", " "), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (r"[\s\x{A0}]+", " ")):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '{_with}', 'g')"


@query("html_to_text", f"SELECT page_id, trim({_BARE}) AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.html_to_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "text")


@query("add_provenance", "SELECT doc_id, 'crawl' AS _source FROM documents")
def add_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.add_provenance(docs(spark, sf_dir), "crawl").select("doc_id", "_source")


@query("model_score", "SELECT doc_id, length(text)::DOUBLE AS model_score FROM documents")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.model_score(docs(spark, sf_dir), lambda ts: [float(len(t)) for t in ts]).select("doc_id", "model_score")


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    d = docs(spark, sf_dir)
    return [d.where("lang = 'en'"), d.where("lang IS DISTINCT FROM 'en'")]


@query("blend_datasets", """WITH sizes AS (SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS en FROM documents), quotas AS (SELECT round(total * 0.75) AS q, en AS n, true AS english FROM sizes UNION ALL SELECT round(total * 0.25), total - en, false FROM sizes)
SELECT english, q::BIGINT AS rows, least(q, n)::BIGINT AS documents, (ceil(q / n))::BIGINT AS most FROM quotas""")
def blend_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of three parts to one of as many rows as there are: rows, different documents and copies of one at most, by part."""
    mixed = tx.blend_datasets(_halves(spark, sf_dir), "doc_id", [3, 1])
    copies = mixed.groupBy(F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english"), "doc_id").agg(F.count("*").alias("n"))
    return copies.groupBy("english").agg(F.sum("n").alias("rows"), F.count("*").alias("documents"), F.max("n").alias("most"))


@query("blend_whole", "SELECT doc_id, lang, text FROM documents")
def blend_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the sizes themselves a mix is every row once."""
    parts = _halves(spark, sf_dir)
    return tx.blend_datasets(parts, "doc_id", [float(p.count()) for p in parts]).select("doc_id", "lang", "text")


@query("blend_by_tokens", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS _source, text FROM documents")
def blend_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dict(zip(("english", "other"), _halves(spark, sf_dir), strict=True))
    sizes = {k: float(p.agg(F.sum(F.octet_length("text"))).first()[0] or 0) for k, p in parts.items()}
    return tx.blend_by_tokens(parts, "doc_id", sizes).select("doc_id", "_source", "text")


@query("blend_by_tokens_shares", "SELECT true AS near")
def blend_by_tokens_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a mix of one part to two of the bytes has those shares, up to a document each."""
    parts = dict(zip(("english", "other"), _halves(spark, sf_dir), strict=True))
    mixed = tx.blend_by_tokens(parts, "doc_id", {"english": 1.0, "other": 2.0})
    total = docs(spark, sf_dir).agg(F.sum(F.octet_length("text").cast("bigint")).alias("t"), F.max(F.octet_length("text")).alias("m"))
    sums = mixed.groupBy("_source").agg(F.sum(F.octet_length("text").cast("bigint")).alias("s"))
    off = F.col("s") - F.col("t") * F.when(F.col("_source") == "english", 1).otherwise(2) / 3
    return sums.join(F.broadcast(total)).select(((off >= 0) & (off <= F.col("m"))).alias("near")).groupBy().agg(F.bool_and("near").alias("near"))


@query("sample_dropped", f"SELECT md5(text) AS h, count(*) - 1 AS n FROM (SELECT {_NORM} AS text FROM documents WHERE text IS NOT NULL) GROUP BY text HAVING count(*) > 1")
def sample_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that exact deduplication drops, by their texts."""
    d = docs(spark, sf_dir)
    gone = tx.sample_dropped(d, dedup.exact_dedup(d, "doc_id"), n=10_000_000)
    return gone.groupBy(F.md5(tx.normalized(F.col("text"))).alias("h")).agg(F.count("*").alias("n"))


_GRAMS = "SELECT {id}, g, {n} AS n FROM (SELECT {id}, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT {id}, list_transform(" + _WORDS + ", lambda w: lower(w)) AS ws FROM {t}), unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS t(i) WHERE len(ws) > 0) GROUP BY ALL"


@query("decontaminate", f"""
WITH items AS ({_GRAMS.format(id='item_id', t='benchmark', n='count(*)')}), grams AS ({_GRAMS.format(id='doc_id', t='documents', n='1')}),
cover AS (SELECT doc_id, item_id, sum(items.n) AS n FROM grams JOIN items USING (g) GROUP BY ALL)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cover JOIN (SELECT item_id, sum(n) AS total FROM items GROUP BY item_id) USING (item_id) WHERE cover.n / total > 0.2)""")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decontaminate(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "item_id").select("doc_id")


_BIGRAMS = f"grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 1], ' ') AS g FROM (SELECT doc_id, list_transform({_WORDS}, lambda w: lower(w)) AS ws FROM documents), unnest(range(1, greatest(len(ws) - 2, 0) + 2)) AS t(i) WHERE len(ws) > 0)"


@query("fuzzy_dedup", f"""
WITH RECURSIVE {_BIGRAMS}, sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
alike AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.7),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, alike.b FROM reach JOIN alike ON alike.a = reach.b)
SELECT a AS doc_id, min(b) AS cluster_id FROM reach GROUP BY a""")
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL compares all pairs; signatures lose a pair at the threshold with a probability of 0.07, none in the tables that are checked."""
    return dedup.fuzzy_dedup(docs(spark, sf_dir), "doc_id", keep_cluster=True).select("doc_id", "cluster_id")


def _minhash_sql(num_hashes: int) -> str:
    p = dedup.PRIME
    fnv = "list_reduce(list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INTEGER::HUGEINT), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)"
    pairs = ", ".join(f"{{'a': {a}::HUGEINT, 'b': {b}::HUGEINT}}" for a, b in zip(*(x.tolist() for x in dedup._coefficients(num_hashes, 1)), strict=True))
    return f"""WITH {_BIGRAMS}, hashed AS (SELECT doc_id, {fnv} % {p} AS x FROM (SELECT doc_id, g, hex(encode(g)) AS h FROM grams)),
    functions AS (SELECT unnest([{pairs}]) AS f, generate_series AS i FROM generate_series(1, 1)), numbered AS (SELECT f.a AS a, f.b AS b, row_number() OVER () AS i FROM functions),
    least AS (SELECT doc_id, i, min((a * x + b) % {p})::BIGINT AS m FROM hashed, numbered GROUP BY ALL)
    SELECT doc_id, coalesce((SELECT list(m ORDER BY i) FROM least WHERE least.doc_id = documents.doc_id), list_transform(range(0, {num_hashes}), lambda i: 0::BIGINT)) AS minhash FROM documents"""


@query("minhash_signatures", _minhash_sql(16))
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen of the functions, the same whatever their number."""
    return dedup.minhash_signatures(docs(spark, sf_dir), num_hashes=16).select("doc_id", "minhash")


@query("signature_similarity", "SELECT doc_id, 1.0::DOUBLE AS same FROM documents")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup.minhash_signatures(tx.normalize_text(dedup.minhash_signatures(docs(spark, sf_dir), out_column="a")), out_column="b")
    return d.select("doc_id", dedup.signature_similarity(F.col("a"), F.col("b")).alias("same"))


@query("lsh_band_keys", "SELECT doc_id, 14::BIGINT AS bands, 14::BIGINT AS shared FROM documents")
def lsh_band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a text and of the same one with more white space."""
    d = docs(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("  "), F.regexp_replace("text", " ", "  ")).alias("loud"))
    both = dedup.minhash_signatures(dedup.minhash_signatures(d, "text", out_column="a"), "loud", out_column="b")
    keys = both.select("doc_id", dedup.lsh_band_keys(F.col("a"), 14, 9).alias("a"), dedup.lsh_band_keys(F.col("b"), 14, 9).alias("b"))
    return keys.select("doc_id", F.size("a").cast("bigint").alias("bands"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"))


@query("substring_dedup", f"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM d, unnest(range(1, greatest(len(ws) - 48, 1))) AS t(i)),
firsts AS (SELECT h, min({{'d': doc_id, 'p': pos}}) AS f FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, pos + k AS place FROM w JOIN firsts USING (h), unnest(range(0, 50)) AS t(k) WHERE {{'d': doc_id, 'p': pos}} <> f),
cut AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN cut.places IS NULL THEN text ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(cut.places, x[2])), lambda x: x[1]), ' ') END AS text FROM d LEFT JOIN cut USING (doc_id)""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.substring_dedup(docs(spark, sf_dir), "doc_id").select("doc_id", "text")


@query("contamination_ratio", f"""
WITH known AS (SELECT DISTINCT g FROM ({_GRAMS.format(id='item_id', t='benchmark', n='1')})), own AS ({_GRAMS.format(id='doc_id', t='documents', n='count(*)')}),
found AS (SELECT doc_id, sum(n) FILTER (g IN (SELECT g FROM known)) / sum(n) AS r FROM own GROUP BY doc_id) SELECT d.doc_id, round(coalesce(r, 0), 6) AS contamination FROM documents d LEFT JOIN found USING (doc_id)""")
def contamination_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.contamination_ratio(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", sql_round("contamination"))


_SPREAD = ", ".join(f"l{i} AS MATERIALIZED (SELECT node, min(least(c, l)) AS l FROM (SELECT u.b AS node, x.l AS c, y.l AS l FROM u JOIN l{i - 1} x ON x.node = u.a JOIN l{i - 1} y ON y.node = u.b) GROUP BY node)" for i in range(1, 13))


@query("connected_components", f"""
WITH e AS (SELECT DISTINCT 2 * l_orderkey AS a, 2 * l_partkey + 1 AS b FROM lineitem), u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
l0 AS (SELECT DISTINCT a AS node, a AS l FROM u), {_SPREAD} SELECT node, l AS component FROM l12""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the parts in them, over all of lineitem: orders are the even nodes, parts the odd ones. The SQL hands the smallest label on twelve times, which reaches all."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("2 * l_orderkey AS a", "2 * l_partkey + 1 AS b")
    return components.connected_components(e)


@query("profile", f"SELECT count(*) AS rows, round(1 - count(DISTINCT {_NORM}) / count(*), 6) AS dup_rate, list_sort(list(length(text)))[least(floor(0.5 * count(*))::BIGINT + 1, count(*))] AS length_p50, list_sort(list(length(text)))[least(floor(0.95 * count(*))::BIGINT + 1, count(*))] AS length_p95 FROM documents")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.profile(docs(spark, sf_dir)).select("rows", sql_round("dup_rate"), F.col("length_p50").cast("bigint").alias("length_p50"), F.col("length_p95").cast("bigint").alias("length_p95"))


@query("global_shuffle", "SELECT doc_id FROM documents")
def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.global_shuffle(docs(spark, sf_dir), "doc_id").select("doc_id")


# vectors


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = f"{Q}::DOUBLE[]"
_D = "embedding::DOUBLE[]"


@query("knn_cosine", f"SELECT vec_id, round(d, 5) AS d FROM (SELECT vec_id, 1 - list_cosine_similarity({_D}, {_QSQL}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn(emb(spark, sf_dir), "embedding", Q, 10, "cosine", "vec_id").select("vec_id", F.round("_distance", 5).alias("d"))


@query("knn_l2", f"SELECT vec_id, round(d, 5) AS d FROM (SELECT vec_id, list_distance({_D}, {_QSQL}) AS d FROM embeddings WHERE label > 2) ORDER BY d, vec_id LIMIT 10")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn(emb(spark, sf_dir), "embedding", Q, 10, "l2", "vec_id", where="label > 2").select("vec_id", F.round("_distance", 5).alias("d"))


@query("knn_ip", f"SELECT vec_id, round(d, 5) AS d FROM (SELECT vec_id, -list_inner_product({_D}, {_QSQL}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn(emb(spark, sf_dir), "embedding", Q, 10, "ip", "vec_id").select("vec_id", F.round("_distance", 5).alias("d"))


@query("add_similarity", f"SELECT vec_id, round(list_cosine_similarity({_D}, {_QSQL}), 5) AS similarity FROM embeddings")
def add_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.add_similarity(emb(spark, sf_dir), "embedding", Q).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("range_search", f"SELECT vec_id FROM embeddings WHERE 1 - list_cosine_similarity({_D}, {_QSQL}) <= 0.9")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_search(emb(spark, sf_dir), "embedding", Q, 0.9).select("vec_id")


@query("knn_batch", f"SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT q.i AS query_id, vec_id, 1 - list_cosine_similarity({_D}, list_transform({_QSQL}, lambda x: x + q.i)) AS d FROM embeddings, (SELECT unnest([1, 2, 3]) AS i) q)) WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn_batch(emb(spark, sf_dir), "embedding", {i: [x + i for x in Q] for i in (1, 2, 3)}, 5, "cosine", "vec_id").select("query_id", "vec_id", "rank")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("mmr", f"""
WITH RECURSIVE c AS (SELECT vec_id, embedding, list_cosine_similarity({_D}, {_QSQL}) AS rel FROM embeddings ORDER BY 1 - list_cosine_similarity({_D}, {_QSQL}), vec_id LIMIT 50),
s AS (SELECT a.vec_id, any_value(a.rel) AS rel, map(list(b.vec_id), list({_COS})) AS likeness FROM c a, c b GROUP BY a.vec_id),
t AS (SELECT 0 AS n, []::BIGINT[] AS chosen UNION ALL SELECT t.n + 1, list_append(t.chosen, arg_max(s.vec_id, round(0.5 * s.rel - 0.5 * coalesce(list_max(list_transform(t.chosen, lambda x: s.likeness[x])), 0.0), 12))) FROM t, s WHERE t.n < 10 AND NOT list_contains(t.chosen, s.vec_id) GROUP BY t.n, t.chosen)
SELECT unnest(chosen) AS vec_id, generate_subscripts(chosen, 1)::INTEGER AS mmr_rank FROM (SELECT chosen FROM t ORDER BY n DESC LIMIT 1)""")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.knn(emb(spark, sf_dir), "embedding", Q, 50, "cosine", "vec_id")
    return vectors.mmr(near, "embedding", Q, 10, id_column="vec_id").select("vec_id", "mmr_rank")


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return vectors.assign_clusters(e, vectors.kmeans(e, k=8, max_iter=10)).select("vec_id", "cluster")


@query("kmeans_converged", "SELECT vec_id, true AS nearest FROM embeddings")
def kmeans_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every vector is in the cluster of the nearest mean once the means no longer move."""
    import numpy as np

    e = emb(spark, sf_dir)
    found = vectors.assign_clusters(e, vectors.kmeans(e, k=8, max_iter=100_000, tol=0.0))
    means = found.groupBy("cluster").agg(*(F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(64))).orderBy("cluster").collect()
    again = vectors.assign_clusters(found, np.array([r[1:] for r in means]), out_column="again")
    number = {r["cluster"]: i for i, r in enumerate(means)}
    return again.select("vec_id", (F.create_map(*(F.lit(x) for kv in number.items() for x in kv))[F.col("cluster")] == F.col("again")).alias("nearest"))


def greedy_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding FROM embeddings), s AS (SELECT a.i AS i, b.i AS j, {_COS} AS c FROM e a JOIN e b ON b.i < a.i WHERE {_COS} >= {threshold}),
t AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS own UNION ALL SELECT t.i + 1, list_append(any_value(own), coalesce(arg_max(s.j, s.c), t.i + 1)) FROM t LEFT JOIN s ON s.i = t.i + 1 AND own[s.j] = s.j WHERE t.i < (SELECT count(*) FROM e) GROUP BY t.i)
SELECT e.vec_id, k.vec_id AS semantic_cluster FROM e, (SELECT own FROM t ORDER BY i DESC LIMIT 1) o, e k WHERE k.i = o.own[e.i]"""


@query("semantic_dedup", greedy_sql(0.9))
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.semantic_dedup(emb(spark, sf_dir), "vec_id", threshold=0.9, keep_cluster=True).select("vec_id", "semantic_cluster")


@query("semantic_dedup_clustered")
def semantic_dedup_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.semantic_dedup_clustered(emb(spark, sf_dir), "vec_id", n_clusters=16).select("vec_id")


# text search

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_BM25 = f"""WITH d AS (SELECT doc_id, {_TOK} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
terms AS (SELECT unnest(['stupid', 'the', 'license']) AS t), tf AS (SELECT doc_id, len(ws) AS l, t, len(list_filter(ws, lambda x: x = t)) AS f FROM d, terms),
df AS (SELECT t, count(*) FILTER (f > 0) AS df FROM tf GROUP BY t),
score AS (SELECT doc_id, sum(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (t), s GROUP BY doc_id HAVING max(f) > 0)"""


@query("bm25", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM score")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(docs(spark, sf_dir), "stupid the license", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("full_text_search", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM score ORDER BY score DESC, doc_id LIMIT 10")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text_search(docs(spark, sf_dir), "stupid the license", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("text_index", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM score ORDER BY score DESC, doc_id LIMIT 10")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by postings that are written first."""
    index = search.TextIndex.build(docs(spark, sf_dir), scratch(spark, "text-index"), "doc_id")
    return index.search("stupid the license").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("hybrid_search", _BM25 + f""", t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM score QUALIFY r <= 20), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity({_D}, {_QSQL}), vec_id) AS r FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY r <= 20)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector are found by their texts alone."""
    both = docs(spark, sf_dir).join(emb(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return search.hybrid_search(both, "stupid the license", Q, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("search_then_sql", f"SELECT label, count(*) AS n FROM (SELECT vec_id, label FROM embeddings ORDER BY round(1 - list_cosine_similarity({_D}, {_QSQL}), 9), vec_id LIMIT 50) GROUP BY label")
def search_then_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.knn(emb(spark, sf_dir), "embedding", Q, 50, "cosine", "vec_id")
    return search.search_then_sql(spark, "SELECT label, count(*) AS n FROM hits GROUP BY label", {"hits": hits})


# tokens


_IDS = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::INTEGER) || [256]"


@query("tokenize_bytes", f"SELECT doc_id, {_IDS} AS input_ids, (strlen(coalesce(text, '')) + 1)::INTEGER AS n_tokens FROM documents")
def tokenize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs(spark, sf_dir)).select("doc_id", "input_ids", "n_tokens")


@query("pack_sequences", f"""
WITH ids AS (SELECT doc_id, {_IDS} AS ids FROM documents), placed AS (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM ids),
each AS (SELECT a + generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS id FROM placed)
SELECT i // 512 AS seq, list(id ORDER BY i) AS input_ids FROM each GROUP BY seq HAVING count(*) = 512""")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_sequences(tokens.tokenize(docs(spark, sf_dir)), "doc_id", seq_len=512).select("seq", "input_ids")


# media, made here


@query("image_hash")
def image_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    @F.udf("binary", useArrow=True)
    def paint(i: int) -> bytes:
        y, x = np.mgrid[0:24, 0:32]
        return media.encode_png(np.stack([(x * 7 + i * 31) % 256, (y * 9 + i * 17) % 256, (x * y + i) % 256], axis=-1).astype(np.uint8))

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", paint("n_nationkey").alias("image"))
    return media.add_image_quality(media.add_image_hash(n)).drop("image")


# streams, run as batches


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "1 hour", value="value").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("window_session", "SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["user_id"], "30 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("sessionize", "SELECT user_id, count(*) FILTER (fresh) AS sessions FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events) GROUP BY user_id")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gap = (F.col("ts").cast("timestamp") - F.lag("ts").over(w).cast("timestamp")) >= F.expr("INTERVAL 30 MINUTE")
    return e.select("user_id", F.coalesce(gap, F.lit(True)).alias("fresh")).groupBy("user_id").agg(F.count_if("fresh").alias("sessions"))
