"""Queries over texts: normal forms, similarities, novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import files, text, urls
from veriframe.operators import similarity
from veriframe.plans import sql
from veriframe.sources.tables import table


def text_normal_forms(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    return t.select(
        "item_id",
        F.sha2(text.clean_text("text"), 256).alias("clean_sha"),
        F.sha2(text.clean_name("text"), 256).alias("name_sha"),
        F.size(text.words("text")).cast("long").alias("n_words"),
        F.size(text.token_set("text")).cast("long").alias("n_tokens"),
        F.size(text.semantic_tokens("text")).cast("long").alias("n_semantic"),
    )


def document_tokens(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.groupBy("lang").agg(
        F.sum(F.size(text.words("text"))).alias("words"), F.sum(F.size(text.token_set("text"))).alias("tokens"),
        F.sum(F.length(text.clean_name("text"))).alias("name_chars"), F.count("*").alias("documents"),
    )


def _benchmark_pairs(spark, sf_dir: str, tokens) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", tokens.alias("tokens"))
    each = t.select("item_id", F.explode("tokens").alias("token"), F.size("tokens").alias("n"))
    left, right = each.toDF("a", "token", "n_a"), each.toDF("b", "token", "n_b")
    return left.join(right, "token").where("a < b")


def token_jaccard_pairs(spark, sf_dir: str) -> DataFrame:
    """Pairs that share a token, by the join on tokens."""
    pairs = _benchmark_pairs(spark, sf_dir, text.token_set("text")).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return pairs.select("a", "b", "both", F.round(score, 9).alias("jaccard"))


def trigram_cosine_pairs(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    counts = t.select("item_id", F.explode(text.grams("text")).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))
    norms = counts.groupBy("item_id").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    a, b = counts.toDF("a", "gram", "x"), counts.toDF("b", "gram", "y")
    dots = a.join(b, "gram").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    dots = dots.join(norms.toDF("a", "norm_a"), "a").join(norms.toDF("b", "norm_b"), "b")
    return dots.select("a", "b", F.round(F.col("dot") / F.sqrt(F.col("norm_a") * F.col("norm_b").cast("double")), 9).alias("cosine"))


def fuzzy_part_names(spark, sf_dir: str) -> DataFrame:
    """Pairs of distinct product names with an edit similarity of 0.6 or more."""
    names = table(spark, sf_dir, "part").select(text.alnum("p_name").alias("name")).where("name is not null").distinct()
    return similarity.similar_names(names, 0.6)


def contamination(spark, sf_dir: str) -> DataFrame:
    """Shared five-word shingles of documents and benchmark items, and their share of the item's."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = similarity.shared_shingles(documents, "doc_id", items, 5)
    return hits.select("doc_id", F.col("id").alias("item_id"), "shared", F.round(F.col("shared") / F.col("n"), 9).alias("share")).where("share >= 0.5")


def passage_novelty(spark, sf_dir: str) -> DataFrame:
    """Sentences of benchmark items whose shingles are novel against the documents: 3 or more and 30 % or more."""
    b = table(spark, sf_dir, "benchmark")
    sentences = b.select("item_id", F.posexplode(F.split("text", r"(?<=[.!?])[\x09-\x0D\x20]+|\n+")).alias("place", "text"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = similarity.novel_shingles(sentences, ["item_id", "place"], documents, 5)
    return rows.where("novel >= 3 and novel >= 0.3 * n").select("item_id", F.col("place").cast("long").alias("place"), "novel", "n")


def exact_text_candidates(spark, sf_dir: str) -> DataFrame:
    """Documents by the hash of their clean text across two halves of the sources: UNIQUE, AMBIGUOUS or NONE."""
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(text.clean_text("text"), 256).alias("key"))
    first = F.col("source") < "src2"
    left = t.where(first).select(F.col("doc_id").alias("source_id"), "key")
    right = t.where(~first).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("target"))
    both = left.join(right, "key", "left")
    return both.select("source_id", F.when(F.col("n").isNull(), "NONE").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("kind"), F.when(F.col("n") == 1, F.col("target")).alias("target_id"))


def sha_provenance(spark, sf_dir: str) -> DataFrame:
    """Groups of documents with one content hash: members, first of them and how many sources they name."""
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return t.groupBy("sha256").agg(F.count("*").alias("members"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).where("members > 1")


def url_normalize(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.normal_url("url").alias("normal"), urls.is_safe_web_url("url").alias("safe"), files.file_name("url").alias("file"), files.looks_like_asset("url").alias("asset"))


def link_dedupe(spark, sf_dir: str) -> DataFrame:
    """Distinct links of each page in order, with the number of their places."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.html_links("html")).alias("place", "link"))
    return p.groupBy("page_id", "link").agg(F.count("*").alias("places"), F.min("place").cast("long").alias("first"))


def shared_links(spark, sf_dir: str) -> DataFrame:
    """Links that stand on several pages, and the first page of each."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(urls.html_links("html")).alias("link"))
    return p.groupBy("link").agg(F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first")).where("pages > 1")


def html_text(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


def page_titles(spark, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_name(title).alias("title_key"), text.is_administrative(title).alias("administrative"), F.regexp_extract("html", r'(?i)<html lang="([a-z]+)"', 1).alias("lang"))


def file_keys(spark, sf_dir: str) -> DataFrame:
    """Package keys of product names saved under several file names."""
    p = table(spark, sf_dir, "part")
    saved = F.concat(F.initcap("p_name"), F.when(F.col("p_size") > 25, F.concat(F.lit(" ("), F.pmod("p_size", F.lit(4)), F.lit(") (2)"))).otherwise(""), F.lit(".ZIP"))
    return p.select("p_partkey", files.match_key(saved).alias("match_key"), files.normal_file_name(saved).alias("normal"), files.display_file_name(saved).alias("display"), files.semantic_key(saved).alias("semantic"))


def item_types(spark, sf_dir: str) -> DataFrame:
    """Event and segment names put to the canonical item types."""
    names = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" quiz")).alias("name")).union(table(spark, sf_dir, "customer").select(F.concat(F.lit("peer "), "c_mktsegment")))
    names = names.union(table(spark, sf_dir, "events").select("event_type")).union(table(spark, sf_dir, "part").select("p_type"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", text.item_type("name").alias("type"), "n")


def repeated_lines(spark, sf_dir: str) -> DataFrame:
    """Normal forms of lines that three or more documents share."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    t = t.select("doc_id", text.clean_name("line").alias("line")).where("length(line) >= 20")
    return t.groupBy("line").agg(F.count_distinct("doc_id").alias("documents")).where("documents >= 3").select(F.md5("line").alias("line_md5"), "documents")


def placeholders(spark, sf_dir: str) -> DataFrame:
    """Personal and secret values in documents by kind."""
    t = table(spark, sf_dir, "documents")
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "address": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "long_number": r"\b\d{16}\b", "hex_key": r"\b[0-9a-f]{40}\b"}
    return t.select("doc_id", *(F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long").alias(k) for k, p in kinds.items()))


def chat_turn_pairs(spark, sf_dir: str) -> DataFrame:
    """Share of an answer's tokens that its question has, for neighbouring turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.token_set("text").alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    prior = c.withColumns({"asked": F.lag("tokens").over(w), "asker": F.lag("role").over(w)})
    rows = prior.where("role = 'assistant' and asker = 'user'")
    return rows.select("conv_id", "turn", F.round(files.token_coverage(F.col("tokens"), F.col("asked")), 9).alias("coverage"))


def answer_coverage(spark, sf_dir: str) -> DataFrame:
    """How much of each user turn stands in the answer after it."""
    key = lambda turn: F.concat_ws(":", "conv_id", turn)
    c = table(spark, sf_dir, "conversations").select(key("turn").alias("id"), key(F.col("turn") + 1).alias("next"), "text", "role")
    asked = c.where("role = 'user'")
    pairs = asked.select(F.col("id").alias("source_id"), F.col("next").alias("target_id"))
    return similarity.directional_coverage(pairs, asked.select("id", "text"), c.where("role = 'assistant'").select("id", "text"))


_ALL_WORDS = sql.words("text")
_SHINGLES = "list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN generate_series(1, len(w) - 4)])"

QUERIES = {f.__name__: f for f in (
    text_normal_forms, document_tokens, token_jaccard_pairs, trigram_cosine_pairs, fuzzy_part_names, contamination, passage_novelty, exact_text_candidates, sha_provenance,
    url_normalize, link_dedupe, shared_links, html_text, page_titles, file_keys, item_types, repeated_lines, placeholders, chat_turn_pairs, answer_coverage,
)}

_NORMAL_URL = r"""
  CASE WHEN NOT regexp_matches(u, '(?i)^https?://') THEN ''
  ELSE regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/?#]+)', 1)), '^www\.', '')
    || coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '/+', '/', 'g'), '/+$', ''), ''), '/')
    || CASE WHEN q = '' THEN '' ELSE '?' || q END
    || regexp_extract(u, '#.*$') END"""
_HTML = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),"
    r" '(?i)</?(?:p|div|br|li|h[1-6]|tr)\b[^>]*>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g')"
)
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
    _HTML = f"regexp_replace({_HTML}, '(?i){_entity}', '{_char}', 'g')"
_HTML = rf"regexp_replace({_HTML}, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z', '', 'g')"

_SAVED = "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') || CASE WHEN p_size > 25 THEN ' (' || (p_size % 4) || ') (2)' ELSE '' END"

ORACLE_SQL = {
    "text_normal_forms": f"""SELECT item_id, sha256({sql.clean('text')}) AS clean_sha, sha256({sql.name('text')}) AS name_sha, len({_ALL_WORDS})::BIGINT AS n_words,
        len({sql.token_set('text')})::BIGINT AS n_tokens, len({sql.semantic_tokens('text')})::BIGINT AS n_semantic FROM benchmark""",
    "document_tokens": f"""SELECT lang, sum(len({_ALL_WORDS}))::BIGINT AS words, sum(len({sql.token_set('text')}))::BIGINT AS tokens, sum(length({sql.name('text')}))::BIGINT AS name_chars, count(*) AS documents
        FROM documents GROUP BY lang""",
    "token_jaccard_pairs": f"""WITH t AS (SELECT item_id, {sql.token_set('text')} AS s FROM benchmark), e AS (SELECT item_id, len(s) AS n, unnest(s) AS token FROM t)
        SELECT a.item_id AS a, b.item_id AS b, count(*) AS both, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 9) AS jaccard
        FROM e a JOIN e b ON a.token = b.token AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id, a.n, b.n""",
    "trigram_cosine_pairs": f"""WITH t AS (SELECT item_id, lower({sql.clean('text')}) AS s FROM benchmark), g AS (SELECT item_id, s[i:i+2] AS gram, count(*) AS n FROM (SELECT item_id, s, unnest(generate_series(1, length(s) - 2)) AS i FROM t) GROUP BY ALL),
        m AS (SELECT item_id, sum(n * n) AS norm FROM g GROUP BY ALL),
        d AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.n * y.n) AS dot FROM g x JOIN g y ON x.gram = y.gram AND x.item_id < y.item_id GROUP BY ALL)
        SELECT a, b, round(dot::DOUBLE / sqrt(p.norm::DOUBLE * q.norm::DOUBLE), 9) AS cosine FROM d JOIN m p ON p.item_id = a JOIN m q ON q.item_id = b""",
    "fuzzy_part_names": f"""WITH n AS (SELECT DISTINCT {sql.alnum('p_name')} AS s FROM part)
        SELECT a.s AS a, b.s AS b, round({sql.edit('a.s', 'b.s')}, 9) AS score FROM n a JOIN n b ON a.s < b.s
        WHERE round({sql.edit('a.s', 'b.s')}, 9) >= 0.6""",
    "contamination": f"""WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_ALL_WORDS} AS w FROM documents) WHERE len(w) > 4),
        b AS (SELECT item_id, len(x) AS n, unnest(x) AS s FROM (SELECT item_id, {_SHINGLES} AS x FROM (SELECT item_id, {_ALL_WORDS} AS w FROM benchmark) WHERE len(w) > 4))
        SELECT doc_id, item_id, count(*) AS shared, round(count(*)::DOUBLE / n, 9) AS share FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n HAVING round(count(*)::DOUBLE / n, 9) >= 0.5""",
    "passage_novelty": None,
    "exact_text_candidates": f"""WITH t AS (SELECT doc_id, source < 'src2' AS first, sha256({sql.clean('text')}) AS key FROM documents), r AS (SELECT key, count(*) AS n, min(doc_id) AS target FROM t WHERE NOT first GROUP BY key)
        SELECT doc_id AS source_id, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS kind, CASE WHEN n = 1 THEN target END AS target_id
        FROM t LEFT JOIN r USING (key) WHERE first""",
    "sha_provenance": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS members, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents GROUP BY ALL HAVING count(*) > 1",
    "url_normalize": rf"""WITH p AS (SELECT page_id, {sql.clean('url')} AS u, url FROM pages),
        k AS (SELECT *, array_to_string([x FOR x IN string_split(regexp_extract(u, '(?i)^https?://[^/?#]+[^?#]*\?([^#]*)', 1), '&') IF x <> '' AND NOT regexp_matches(url_decode(string_split(x, '=')[1]), '(?i)^(utm_[a-z0-9_]+|gclid|fbclid|msclkid)$')], '&') AS q FROM p)
        SELECT page_id, {_NORMAL_URL} AS normal, regexp_matches(url, '(?i)^https?://[^/?#@\s]+([/?#]\S*)?$') AS safe,
          url_decode(list_last(string_split(regexp_replace(url, '[#?].*', ''), '/'))) AS file,
          regexp_matches(url, '(?i)\.(pdf|pptx?|docx?|xlsx?|csv|zip|png|jpe?g|gif|svg|mp4|webm|mp3|wav|m4a)($|[?#])') AS asset FROM k""",
    "link_dedupe": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) AS links FROM pages),
        e AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS place FROM l)
        SELECT page_id, link, count(*) AS places, min(place)::BIGINT AS first FROM e GROUP BY ALL""",
    "shared_links": r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1)) AS link FROM pages)
        SELECT link, count(DISTINCT page_id) AS pages, min(page_id) AS first FROM e GROUP BY link HAVING count(DISTINCT page_id) > 1""",
    "html_text": f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "page_titles": rf"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)
        SELECT page_id, {sql.name('title')} AS title_key,
          lower(trim(title)) IN ('resource', 'resources', 'student resource', 'student resources', 'instructor resource', 'instructor resources', 'interactive', 'indirect')
            OR regexp_matches(lower(trim(title)), 'archive|overview|start here|syllabus|instructor') AS administrative,
          regexp_extract(html, '(?i)<html lang="([a-z]+)"', 1) AS lang FROM p""",
    "file_keys": f"""WITH p AS (SELECT p_partkey, p_name, p_size, {_SAVED} AS saved FROM part)
        SELECT p_partkey, replace(lower(p_name), ' ', '') AS match_key, lower(saved) || '.zip' AS normal, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') || '.ZIP' AS display,
          replace(lower(p_name), ' ', '') AS semantic FROM p""",
    "item_types": """WITH n AS (SELECT event_type || ' quiz' AS name FROM events UNION ALL SELECT 'peer ' || c_mktsegment FROM customer UNION ALL SELECT event_type FROM events UNION ALL SELECT p_type FROM part)
        SELECT name, CASE WHEN contains(name, 'quiz') THEN 'Assessment' WHEN name LIKE 'peer %' THEN 'Assignment' ELSE name END AS type, count(*) AS n FROM n GROUP BY name""",
    "repeated_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, {sql.name('line')} AS line FROM l)
        SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS documents FROM k WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) >= 3""",
    "placeholders": r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS email, len(regexp_extract_all(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b'))::BIGINT AS address,
        len(regexp_extract_all(text, '\b\d{16}\b'))::BIGINT AS long_number, len(regexp_extract_all(text, '\b[0-9a-f]{40}\b'))::BIGINT AS hex_key FROM documents""",
    "chat_turn_pairs": f"""WITH c AS (SELECT conv_id, turn, role, {sql.token_set('text')} AS s FROM conversations), p AS (SELECT *, lag(s) OVER w AS asked, lag(role) OVER w AS asker FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_intersect(s, asked))::DOUBLE / len(s) END, 9) AS coverage FROM p WHERE role = 'assistant' AND asker = 'user'""",
}
ORACLE_SQL["passage_novelty"] = rf"""WITH d AS (SELECT DISTINCT unnest({_SHINGLES}) AS s FROM (SELECT {_ALL_WORDS} AS w FROM documents) WHERE len(w) > 4),
    cut AS (SELECT item_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[\x09-\x0D\x20]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM benchmark),
    e AS (SELECT item_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS place FROM cut),
    g AS (SELECT item_id, place, unnest({_SHINGLES}) AS s FROM (SELECT item_id, place, {_ALL_WORDS} AS w FROM e) WHERE len(w) > 4)
    SELECT item_id, place::BIGINT AS place, count(*) FILTER (d.s IS NULL) AS novel, count(*) AS n FROM g LEFT JOIN d USING (s) GROUP BY item_id, place
    HAVING count(*) FILTER (d.s IS NULL) >= 3 AND count(*) FILTER (d.s IS NULL) >= 0.3 * count(*)"""
ORACLE_SQL["answer_coverage"] = f"""WITH c AS (SELECT concat_ws(':', conv_id, turn) AS id, concat_ws(':', conv_id, turn + 1) AS next, role, {sql.clean('text')} AS clean, {sql.name('text')} AS normal, {sql.semantic_tokens('text')} AS w FROM conversations),
    f AS (SELECT *, list_distinct(w) AS u, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) AS b FROM c),
    g AS (SELECT id, gram, count(*) AS n FROM (SELECT id, lower(clean)[i:i+2] AS gram FROM (SELECT id, clean, unnest(generate_series(1, length(clean) - 2)) AS i FROM c)) GROUP BY ALL), m AS (SELECT id, sum(n * n)::DOUBLE AS norm FROM g GROUP BY id),
    p AS (SELECT s.id AS source_id, t.id AS target_id, s.clean AS sc, t.clean AS tc, s.normal AS sn, t.normal AS tn, s.w AS sw, t.w AS tw, s.u AS su, t.u AS tu, s.b AS sb, t.b AS tb FROM f s JOIN f t ON t.id = s.next WHERE s.role = 'user' AND t.role = 'assistant'),
    d AS (SELECT source_id, sum(x.n * y.n)::DOUBLE AS dot FROM p JOIN g x ON x.id = source_id JOIN g y ON y.id = target_id AND y.gram = x.gram GROUP BY source_id)
    SELECT p.source_id, p.target_id, round(CASE WHEN length(sc) < 80 OR length(tc) < 80 THEN 0 WHEN length(sn) >= 80 AND contains(tn, sn) THEN 1 WHEN len(sw) < 12 OR len(tw) < 12 THEN 0
      ELSE greatest(0, least(1, len(list_intersect(su, tu))::DOUBLE / len(su) * 0.42::DOUBLE + CASE WHEN len(sb) > 0 THEN len(list_intersect(sb, tb))::DOUBLE / len(sb) ELSE 0 END * 0.43::DOUBLE + coalesce(dot / sqrt(a.norm * b.norm), 0) * 0.15::DOUBLE)) END, 9) AS score
    FROM p LEFT JOIN d USING (source_id) LEFT JOIN m a ON a.id = p.source_id LEFT JOIN m b ON b.id = p.target_id"""
