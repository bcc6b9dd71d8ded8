"""Scalar text functions and text preparation on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.functions import rich_text
from dossierspark.functions import rules as RU
from dossierspark.functions import text as X
from dossierspark.operators import text_jobs as TJ
from dossierspark.operators.ranking import ranked
from dossierspark.plans import sql_text as Q
from dossierspark.plans.registry import Registry
from dossierspark.session import spread, table
from dossierspark.sources import html as H

reg = Registry()

STOP = ["the", "and", "that", "que", "der", "die", "und", "los", "las", "des", "les"]
LONG = lambda c, name="text": [F.md5(c).alias(f"{name}_md5"), F.length(c).cast("long").alias(f"{name}_len")]


def SQL_LONG(c, name="text"):
    return f"md5({c}) AS {name}_md5, length({c}) AS {name}_len"


def docs(spark, d):
    return spread(table(spark, d, "documents"))


# ---- scalars ---------------------------------------------------------------

@reg.add("fn_one_line", f"SELECT page_id, {SQL_LONG(Q.one_line('html'))} FROM pages")
def fn_one_line(spark, d):
    return table(spark, d, "pages").select("page_id", *LONG(X.one_line(F.col("html"))))


@reg.add("fn_normalize", f"""SELECT doc_id, {SQL_LONG(Q.normalize_text('text'))}, md5({Q.text_key("replace(lower(text), '&', ' and ')")}) AS title_md5 FROM documents""")
def fn_normalize(spark, d):
    return docs(spark, d).select("doc_id", *LONG(X.normalize_text(F.col("text"))), F.md5(X.title_key(F.col("text"))).alias("title_md5"))


@reg.add("fn_normalize_rich")
def fn_normalize_rich(spark, d):
    return docs(spark, d).select("doc_id", *LONG(rich_text.normalize_rich(F.col("text"))))


_BASE = f"""{Q.slug("concat_ws('_', split_part(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', ''), '.', 1), CASE WHEN path = '' THEN 'homepage' ELSE " + Q.slug('path') + " END, left(sha256(url), 10))")}"""


@reg.add("fn_source_id", f"""
WITH u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM pages
  UNION ALL SELECT page_id + 1000000, url, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g') FROM pages WHERE page_id % 3 = 0),
b AS (SELECT page_id, {_BASE} AS base FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS r FROM b)
SELECT page_id, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS source_id FROM n""".replace(" WHERE page_id % 3 = 0", ""))
def fn_source_id(spark, d):
    first = table(spark, d, "pages").select("page_id", "url")
    again = first.withColumn("page_id", F.col("page_id") + 1000000)
    base = first.unionByName(again).select("page_id", X.url_source_base(F.col("url")).alias("base"))
    n = ranked(base, ["base"], [F.col("page_id")], "r")
    return n.select("page_id", F.when(F.col("r") == 1, F.col("base")).otherwise(
        F.concat_ws("_", "base", F.col("r").cast("string"))).alias("source_id"))


@reg.add("fn_stable_id", f"""
SELECT doc_id, 'doc_' || {Q.slug("concat_ws('_', nullif(" + Q.one_line('source') + ", ''), nullif(" + Q.one_line('lang') + ", ''), nullif(" + Q.one_line('text') + ", ''))")} || '_' ||
  left(sha256(concat_ws(chr(31), {Q.one_line('source')}, {Q.one_line('lang')}, {Q.one_line('text')})), 10) AS stable_id FROM documents""")
def fn_stable_id(spark, d):
    return docs(spark, d).select("doc_id", X.stable_id("doc", F.col("source"), F.col("lang"), F.col("text")).alias("stable_id"))


@reg.add("fn_code_norm", r"""
WITH t AS (SELECT doc_id AS id, upper(trim(regexp_replace(text, '[ \t\n\r\f\x0B\x00]+', ' ', 'g'))) AS t FROM documents
  UNION ALL SELECT c_custkey + 1000000000, upper(c_name) FROM customer),
m AS (SELECT id, regexp_extract(t, '([0-9]{2})[- ]?([0-9]{4})(?:[. -]?([0-9]{2}))?', 1) AS a, regexp_extract(t, '([0-9]{2})[- ]?([0-9]{4})(?:[. -]?([0-9]{2}))?', 2) AS b,
  regexp_extract(t, '([0-9]{2})[- ]?([0-9]{4})(?:[. -]?([0-9]{2}))?', 3) AS c FROM t)
SELECT id, CASE WHEN a = '' THEN '' ELSE a || '-' || b || '.' || CASE WHEN c = '' THEN '00' ELSE c END END AS code FROM m""")
def fn_code_norm(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(
        table(spark, d, "customer").select((F.col("c_custkey") + 1000000000).alias("id"), F.col("c_name").alias("text")))
    return rows.select("id", X.classification_code(F.col("text")).alias("code"))


@reg.add("fn_parse_number", f"""
SELECT doc_id, {Q.parse_number('text')} AS number,
  CASE WHEN {Q.parse_number('text')} = floor({Q.parse_number('text')}) AND abs({Q.parse_number('text')}) < 1e15 THEN CAST(TRY_CAST({Q.parse_number('text')} AS BIGINT) AS VARCHAR) ELSE md5({Q.one_line('text')}) END AS id_text FROM documents""")
def fn_parse_number(spark, d):
    kept = X.integer_text(F.col("text"))
    whole = X.one_line(F.col("text"))
    return docs(spark, d).select("doc_id", X.parse_number(F.col("text")).alias("number"),
                                 F.when(kept == whole, F.md5(whole)).otherwise(kept).alias("id_text"))


@reg.add("fn_truncate", f"""
SELECT doc_id, CASE WHEN length(t) > 220 THEN rtrim(left(t, 217)) || '...' ELSE t END AS hard,
  CASE WHEN length(t) > 220 THEN rtrim(regexp_replace(left(t, 217), ' [^ ]*$', '')) || '...' ELSE t END AS at_word
FROM (SELECT doc_id, {Q.one_line('text')} AS t FROM documents)""")
def fn_truncate(spark, d):
    return docs(spark, d).select("doc_id", X.truncate(F.col("text"), 220).alias("hard"),
                                 X.truncate_at_word(F.col("text"), 220).alias("at_word"))


@reg.add("fn_embedding_text", """
SELECT p_partkey, concat_ws('; ', 'p_name: ' || p_name, 'p_brand: ' || p_brand, CASE WHEN p_size > 25 THEN 'p_type: ' || p_type END, 'p_size: ' || p_size) AS embedding_text FROM part""")
def fn_embedding_text(spark, d):
    part = table(spark, d, "part").withColumn("p_type", F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""))
    return part.select("p_partkey", X.key_value_text(["p_name", "p_brand", "p_type", "p_size"]).alias("embedding_text"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@reg.add("fn_tokens", f"""
WITH t AS (SELECT doc_id, list_filter(list_distinct(string_split({Q.text_key('text')}, ' ')), lambda x: length(x) > 2 AND x NOT IN ({_STOP_SQL})) AS tok FROM documents)
SELECT doc_id, len(tok) AS n_tokens, md5(array_to_string(list_sort(tok), ' ')) AS tokens_md5 FROM t""")
def fn_tokens(spark, d):
    t = docs(spark, d).select("doc_id", X.tokens(F.col("text"), STOP).alias("tok"))
    return t.select("doc_id", F.size("tok").cast("long").alias("n_tokens"),
                    F.md5(F.array_join(F.array_sort("tok"), " ")).alias("tokens_md5"))


EXPANSIONS = {"ring": ["band", "loop"], "bolt": ["screw", "fastener"], "small": ["little"], "red": ["crimson", "small"]}


@reg.add("fn_expand_terms", """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
e AS (SELECT p_partkey, flatten(list_transform(w, lambda x: list_concat([x], CASE x WHEN 'ring' THEN ['band', 'loop'] WHEN 'bolt' THEN ['screw', 'fastener']
  WHEN 'small' THEN ['little'] WHEN 'red' THEN ['crimson', 'small'] ELSE CAST([] AS VARCHAR[]) END))) AS l FROM t)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM e""")
def fn_expand_terms(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(X.expand_terms(F.split("p_name", " "), EXPANSIONS), "|").alias("terms"))


@reg.add("fn_page_range", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'A' THEN l_linenumber END AS s,
  CASE WHEN l_linestatus = 'O' THEN l_linenumber + CAST(floor(l_quantity / 20) AS INT) END AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s IS NULL AND e IS NULL THEN '' WHEN s IS NULL THEN 'p. ' || e WHEN e IS NULL OR s = e THEN 'p. ' || s ELSE 'pp. ' || s || '-' || e END AS pages FROM p""")
def fn_page_range(spark, d):
    s = F.when(F.col("l_returnflag") != "A", F.col("l_linenumber"))
    e = F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") + F.floor(F.col("l_quantity") / 20).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.page_range(s, e).alias("pages"))


def _redact_sql(c):
    digits = "0123456789+-"
    guard = "".join(chr(0xE000 + i) for i in range(len(digits)))
    for ch, g in zip(digits, guard):
        c = f"regexp_replace({c}, '([A-Za-z])[{'\\' + ch if ch in '+-' else ch}]', '\\1{g}', 'g')"
    c = f"regexp_replace({c}, '[-+]?[0-9]+(?:[.,][0-9]+)*%?', '[number omitted]', 'g')"
    return f"translate({c}, '{guard}', '{digits}')"


@reg.add("fn_redact_numbers", f"SELECT doc_id, {SQL_LONG(_redact_sql('text'))} FROM documents")
def fn_redact_numbers(spark, d):
    return docs(spark, d).select("doc_id", *LONG(X.redact_numbers(F.col("text"))))


@reg.add("fn_dedupe_list", f"""
WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: {Q.one_line('x')}), lambda x: x <> '') AS l FROM conversations),
k AS (SELECT *, list_transform(l, lambda x: lower(x)) AS lk FROM t)
SELECT conv_id, turn, md5(array_to_string(list_filter(l, lambda x, i: list_position(lk, lower(x)) = i), ' ')) AS words_md5,
  len(list_distinct(lk)) AS n_words FROM k""")
def fn_dedupe_list(spark, d):
    words = X.dedupe_list(F.split("text", " "))
    return table(spark, d, "conversations").select("conv_id", "turn", words.alias("w")).select(
        "conv_id", "turn", F.md5(F.array_join("w", " ")).alias("words_md5"), F.size("w").cast("long").alias("n_words"))


@reg.add("fn_plural_variants", """
WITH k AS (SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || CASE WHEN p_size > 40 THEN 's' WHEN p_size > 30 THEN 'ies' WHEN p_size > 20 THEN 'y' WHEN p_size > 10 THEN 'ss' ELSE '' END), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM part),
s AS (SELECT p_partkey, key, regexp_replace(key, '[^ ]+$', '') AS head, regexp_extract(key, '([^ ]+)$', 1) AS w FROM k),
v AS (SELECT p_partkey, [key, head || CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN w[:-4] || 'y' WHEN w LIKE '%ses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END,
  head || CASE WHEN w LIKE '%y' AND length(w) > 1 THEN w[:-2] || 'ies' WHEN w LIKE '%s' THEN w ELSE w || 's' END] AS l FROM s)
SELECT p_partkey, array_to_string(list_sort(list_distinct(l)), '|') AS variants FROM v""")
def fn_plural_variants(spark, d):
    size = F.col("p_size")
    ending = F.when(size > 40, "s").when(size > 30, "ies").when(size > 20, "y").when(size > 10, "ss").otherwise("")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(X.title_variants(F.concat("p_name", ending))), "|").alias("variants"))


# ---- pages -----------------------------------------------------------------

def _html_sql():
    c = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        c = f"regexp_replace({c}, '(?is)<{tag}(?:[ \\t\\r\\n][^>]*)?>.*?</{tag}[ \\t\\r\\n]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', chr(10), 'g')"
    return f"list_filter(list_transform(string_split({_entities(c)}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))), lambda x: x <> '')"


def _entities(c):
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{old}', '{new}')"
    return c


SQL_PAGE_LINES = f"WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, {_html_sql()} AS l FROM pages)"


def page_lines(spark, d):
    return spread(table(spark, d, "pages")).select(
        "page_id", F.regexp_extract("url", "^[A-Za-z]+://([^/?#]+)", 1).alias("host"), H.text_nodes(F.col("html")).alias("lines"))


@reg.add("html_to_text", SQL_PAGE_LINES + f" SELECT page_id, {SQL_LONG('array_to_string(l, chr(10))')} FROM p")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", *LONG(H.html_to_text(F.col("html"))))


@reg.add("html_title", f"""
SELECT page_id, trim(regexp_replace({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '[ \\t\\r\\n]+', ' ', 'g')) AS title,
  regexp_extract(html, '(?i)href="([^"]*[.]pdf)["#?]', 1) AS pdf_link FROM pages""")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.html_title(F.col("html")).alias("title"),
                                           H.first_link(F.col("html"), "[.]pdf").alias("pdf_link"))


SQL_FURNITURE = SQL_PAGE_LINES + """,
e AS (SELECT DISTINCT host, page_id, unnest(list_concat(l[1:4], l[-4:])) AS line FROM p),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
f AS (SELECT host, line, count(*) AS n_pages, any_value(pages) AS pages FROM e JOIN n USING (host) WHERE length(line) <= 160 GROUP BY host, line
  HAVING count(*) >= greatest(3, floor(any_value(pages) / 4)))"""


@reg.add("agg_page_furniture", SQL_FURNITURE + " SELECT host, line, n_pages, pages FROM f")
def agg_page_furniture(spark, d):
    return TJ.edge_line_counts(page_lines(spark, d), "host", "lines").select("host", "line", "n_pages", "pages")


@reg.add("txt_strip_furniture", SQL_FURNITURE + """,
k AS (SELECT page_id, host, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p),
r AS (SELECT k.* FROM k ANTI JOIN f ON k.host = f.host AND k.line = f.line WHERE NOT regexp_matches(k.line, '^[- ]*[0-9]{1,4}[- ]*$'))
SELECT page_id, count(r.i) AS n_lines, md5(coalesce(string_agg(r.line, chr(10) ORDER BY r.i), '')) AS text_md5 FROM p LEFT JOIN r USING (page_id) GROUP BY 1""")
def txt_strip_furniture(spark, d):
    out = TJ.strip_furniture(page_lines(spark, d), "host", "lines", "kept")
    return out.select("page_id", F.size("kept").cast("long").alias("n_lines"), F.md5(F.array_join("kept", "\n")).alias("text_md5"))


# ---- documents -------------------------------------------------------------

@reg.add("txt_paragraphs", f"""
SELECT doc_id, position, md5(paragraph) AS paragraph_md5 FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, {Q.one_line('unnest(l)')} AS paragraph FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE paragraph <> ''""")
def txt_paragraphs(spark, d):
    return TJ.paragraph_units(docs(spark, d), "doc_id", "text", sep="\n").select(
        "doc_id", "position", F.md5("paragraph").alias("paragraph_md5"))


@reg.add("txt_sentences", f"""
SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, md5(unnest(l)) AS sentence_md5 FROM (SELECT doc_id, {Q.sentences('text')} AS l FROM documents)""")
def txt_sentences(spark, d):
    return TJ.sentence_units(docs(spark, d), "doc_id", "text").select("doc_id", "position", F.md5("sentence").alias("sentence_md5"))


@reg.add("txt_word_count", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_words FROM documents")
def txt_word_count(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"))


@reg.add("txt_chunks")
def txt_chunks(spark, d):
    return TJ.chunk(docs(spark, d), "doc_id", "text", sep=r"\n")


@reg.add("txt_chunks_plain")
def txt_chunks_plain(spark, d):
    return TJ.chunk(docs(spark, d), "doc_id", "text", sep=r"\n", target=None, maximum=850, overlap=0, minimum=1)


@reg.add("txt_chunks_paged")
def txt_chunks_paged(spark, d):
    """Chunks over the ends of pages, here blocks between blank lines, with the page they start on."""
    return TJ.chunk(docs(spark, d), "doc_id", "text", sep=r"\n", target=70, maximum=90, overlap=10, minimum=12, page_sep=r"\n[ \t]*\n")


@reg.add("txt_chunks_relevant", f"""
WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(l, 1) AS page, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents)),
u AS (SELECT doc_id, page, generate_subscripts(l, 1) AS i, {Q.one_line('unnest(l)')} AS t FROM (SELECT doc_id, page, string_split(body, chr(10)) AS l FROM p)),
r AS MATERIALIZED (SELECT doc_id, page, t, len(string_split(t, ' ')) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS pos FROM u
  WHERE length(t) > 20 AND ({Q.sub('lower(t)', 'the', 'que', 'der')})),
f(doc_id, page, pos, grp, words) AS (SELECT doc_id, page, pos, 1, n FROM r WHERE pos = 1
  UNION ALL SELECT r.doc_id, r.page, r.pos, CASE WHEN words + n > 60 THEN grp + 1 ELSE grp END, CASE WHEN words + n > 60 THEN n ELSE words + n END
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.page = f.page AND r.pos = f.pos + 1),
c AS (SELECT doc_id, page, grp, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS body FROM f JOIN r USING (doc_id, page, pos) GROUP BY ALL),
o AS (SELECT doc_id, page, body, min(grp) AS grp FROM c GROUP BY ALL)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY grp) AS chunk_index, md5(body) AS chunk_md5 FROM o""")
def txt_chunks_relevant(spark, d):
    relevant = lambda p: (F.length(p) > 20) & RU.any_substring(F.lower(p), STAT_TERMS)
    return TJ.relevant_chunks(docs(spark, d), "doc_id", "text", relevant, page_sep="\n\n", sep="\n", maximum=60).select(
        "doc_id", "page", "chunk_index", F.md5("chunk_text").alias("chunk_md5"))


WANTED, SKIP = ["thth", "ment", "tion"], ["cookie", "subscribe", "eauou"]


@reg.add("txt_chunk_filter", f"""
WITH t AS (SELECT doc_id, source, text, lower({Q.one_line('text')}) AS n FROM documents)
SELECT doc_id, 'chunk_' || {Q.slug("concat_ws('_', nullif(" + Q.one_line('source') + ", ''), doc_id)")} || '_' || left(sha256(concat_ws(chr(31), {Q.one_line('source')}, CAST(doc_id AS VARCHAR), {Q.one_line('text')})), 10) AS chunk_id
FROM t WHERE CASE WHEN n = '' THEN false WHEN regexp_matches(n, '^(?:the|la)') THEN {Q.sub('n', 'method', 'heed')} WHEN {Q.sub('n', *SKIP)} THEN false ELSE {Q.sub('n', *WANTED)} END""")
def txt_chunk_filter(spark, d):
    keep = TJ.useful_chunk(F.col("text"), WANTED, SKIP, ["the", "la"], ["method", "heed"])
    rows = docs(spark, d).filter(keep)
    readable = X.slug(F.concat_ws("_", F.nullif(X.one_line(F.col("source")), F.lit("")), F.col("doc_id").cast("string")))
    digest = F.substring(F.sha2(F.concat_ws("\x1f", X.one_line(F.col("source")), F.col("doc_id").cast("string"),
                                            X.one_line(F.col("text"))), 256), 1, 10)
    return rows.select("doc_id", F.concat(F.lit("chunk_"), readable, F.lit("_"), digest).alias("chunk_id"))


STAT_TERMS = ["the", "que", "der"]


def _stat_labels(low):
    return [(RU.any_substring(low, ["license", "copyright"]), "legal"), (RU.any_substring(low, ["mail", "phone", "call"]), "contact"),
            (RU.any_substring(low, ["http"]), "link")]


@reg.add("txt_statistics", f"""
WITH s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS l FROM documents)),
f AS (SELECT *, CASE WHEN {Q.sub('lower(sentence)', 'license', 'copyright')} THEN 'legal' WHEN {Q.sub('lower(sentence)', 'mail', 'phone', 'call')} THEN 'contact' WHEN contains(lower(sentence), 'http') THEN 'link' ELSE 'methodology' END AS doc_type
  FROM s WHERE {Q.sub('lower(sentence)', *STAT_TERMS)} AND regexp_matches(sentence, '[0-9]')),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, doc_type, lower(sentence) ORDER BY position) AS r FROM f)
SELECT doc_id, position, doc_type, {Q.parse_number('sentence')} AS metric_value, md5(sentence) AS sentence_md5 FROM k WHERE r = 1""")
def txt_statistics(spark, d):
    out = TJ.statistic_rows(docs(spark, d), "doc_id", "text", STAT_TERMS, "[0-9]", _stat_labels)
    return out.select("doc_id", "position", "doc_type", "metric_value", F.md5("sentence").alias("sentence_md5"))


BAD_TITLE, BAD_AUTHOR = ["copyright", "http", "www.", "license"], ["http", "www", "email", "copyright", "license"]


@reg.add("txt_mine_metadata", rf"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.one_line('x')}), lambda x: x <> '') AS l FROM documents),
t AS (SELECT *, list_filter(list_transform(l, lambda x, i: CASE WHEN NOT {Q.sub('lower(x)', *BAD_TITLE)} AND length(x) BETWEEN 10 AND 200 AND NOT contains(x, '@')
    AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) * 2 >= length(x) THEN i END), lambda v: v IS NOT NULL)[1] AS pos FROM l)
SELECT doc_id, coalesce(l[pos], '') AS title,
  coalesce(array_to_string(list_filter(l[pos + 1:pos + 7], lambda x: NOT {Q.sub('lower(x)', *BAD_AUTHOR)} AND length(x) BETWEEN 3 AND 180
    AND len(regexp_extract_all(x, '(?:^|[^A-Za-z0-9_])[A-Z][A-Za-z-]+')) >= 2)[1:2], '; '), '') AS authors,
  coalesce(list_max(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])(20[0-2][0-9]|19[89][0-9])', 1)), '') AS year,
  regexp_replace(regexp_extract(text, '10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'), '\.+$', '') AS doi FROM t""")
def txt_mine_metadata(spark, d):
    return TJ.mine_metadata(docs(spark, d), "doc_id", "text", BAD_TITLE, BAD_AUTHOR)


@reg.add("txt_dedupe_lines", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text || chr(10) || chr(10) || chr(10) || text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g')) AS l FROM documents),
k AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS r FROM k),
g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM f WHERE x = '' OR r = 1)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(x, chr(10) ORDER BY i)) AS text_md5 FROM g WHERE x <> '' OR prev IS NULL OR prev <> '' GROUP BY 1""")
def txt_dedupe_lines(spark, d):
    doubled = F.split(F.concat("text", F.lit("\n\n\n"), "text"), "\n")
    out = docs(spark, d).select("doc_id", X.dedupe_lines(doubled).alias("k"))
    return out.select("doc_id", F.size("k").cast("long").alias("n_lines"), F.md5(F.array_join("k", "\n")).alias("text_md5"))


SECTION_TEXT_SQL = "'Summary:' || chr(10) || role || chr(10) || 'Tasks:' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || 'Notes:' || chr(10) || 'end'"


@reg.add("txt_extract_section", rf"""
WITH b AS (SELECT conv_id, turn, {SECTION_TEXT_SQL} AS body FROM conversations),
s AS (SELECT conv_id, turn, regexp_extract(body, '(?s)(?:^|\n)Tasks:[ \t]*\n(.*?)(?:\n[A-Z][A-Za-z /&-]*:[ \t]*(?:\n|$)|$)', 1) AS tasks FROM b),
t AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(tasks, chr(10)), lambda x: {Q.one_line('x')}), lambda x: starts_with(x, '- ')), lambda x: trim(x[3:])),
  lambda x: len(string_split(x, ' ')) >= 4 AND NOT regexp_matches(x, '^[A-Z][A-Za-z /&-]{{2,40}}:')) AS l FROM s)
SELECT conv_id, turn, md5(tasks) AS section_md5, len(l) AS n_tasks, coalesce(l[1], '') AS first_task FROM t""")
def txt_extract_section(spark, d):
    body = F.concat(F.lit("Summary:\n"), "role", F.lit("\nTasks:\n- "), F.regexp_replace("text", "\n", "\n- "), F.lit("\nNotes:\nend"))
    s = table(spark, d, "conversations").select("conv_id", "turn", X.section(body, "Tasks").alias("tasks"))
    t = s.withColumn("l", X.task_lines(F.col("tasks")))
    return t.select("conv_id", "turn", F.md5("tasks").alias("section_md5"), F.size("l").cast("long").alias("n_tasks"),
                    F.coalesce(F.get("l", 0), F.lit("")).alias("first_task"))


@reg.add("txt_context_pack", """
WITH b AS (SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r,
    '[Source]' || chr(10) || 'Language: ' || lang || chr(10) || 'Text:' || chr(10) || text AS block FROM documents),
u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY query ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT query, count(*) AS sources, md5(string_agg(left(block, CAST(12000 - used AS BIGINT)), chr(10) || chr(10) ORDER BY r)) AS context_md5 FROM u WHERE used < 12000 GROUP BY 1""")
def txt_context_pack(spark, d):
    block = F.concat(F.lit("[Source]\nLanguage: "), "lang", F.lit("\nText:\n"), "text")
    hits = docs(spark, d).withColumn("order_key", F.struct(-F.col("n_chars"), F.col("doc_id")))
    out = TJ.pack_context(hits.withColumnRenamed("source", "query"), "query", "order_key", block)
    return out.select("query", "sources", F.md5("context").alias("context_md5"))
