"""SQL that gives the catalogue's rows by other means.

Where the plans join tokens and resolve overlaps by islands, the SQL scans a canonical string of tokens with one
regular expression whose longer alternatives come first.
"""

from __future__ import annotations

from lexiflux.functions.html import BOILERPLATE, DROP_TAGS
from lexiflux.functions.text import UNITS

_UNITS = "|".join(UNITS)
_DOCS = rf"""
src AS (
  SELECT doc_id, source AS symbol,
         CASE WHEN source IN ('src0','src1','src2','src3') THEN 'page' WHEN source = 'src4' THEN 'data' WHEN lang = 'en' THEN 'main' WHEN lang = 'de' THEN 'data' ELSE 'page' END AS doc_kind,
         lower(regexp_replace(replace(text || ' ' || n_chars || ' tonnes in ' || (1990 + doc_id % 60), '’', ''''), '\s+', ' ', 'g')) AS norm
  FROM documents),
docs AS (
  SELECT doc_id, symbol, doc_kind, symbol || '__' || doc_kind || '_' || doc_id || '.txt' AS file,
         CAST(len(regexp_extract_all(norm, '[a-z][a-z''-]*')) AS BIGINT) AS n_words,
         CAST(len(regexp_extract_all(norm, '\b\d[\d,]*(?:\.\d+)?\s?(?:{_UNITS})\b|\$\s?\d[\d,]*(?:\.\d+)?')) AS BIGINT) AS quantity_hits,
         CAST(len(regexp_extract_all(norm, '\b(?:19|20)\d{{2}}\b')) AS BIGINT) AS year_hits
  FROM src)"""
_GAP = r"[^a-z0-9_]*[^a-z0-9_ \t\n\r\f\v\-''\x{2010}-\x{2015}\x{2019}&][^a-z0-9_]*"
_CANON = rf"""
listed AS (
  SELECT doc_id, symbol, regexp_extract_all(trim(regexp_replace(norm, '{_GAP}', ' @ ', 'g'), ' @'), '[a-z0-9_]+|@') AS toks FROM src),
canon AS (SELECT doc_id, symbol, replace(' ' || array_to_string(toks, '  ') || ' ', ' of  that ', ' of  that# ') AS s FROM listed)"""
_STREAM = """
stream AS (SELECT doc_id, unnest(toks) AS t0, generate_subscripts(toks, 1) - 1 AS pos FROM listed),
wide AS (
  SELECT doc_id, pos, t0, lead(t0) OVER w AS t1, lead(t0, 2) OVER w AS t2, lag(t0) OVER w AS b1, lag(t0, 2) OVER w AS b2
  FROM stream WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_LEXICON = """
lexicon(term_id, label, tier, weight) AS (VALUES
  (0, 'the', 'puffery', 1.0::DOUBLE), (1, 'of the', 'hedge', 1.0), (2, 'prep the', 'corporate', 1.5), (3, 'for the', 'esg_jargon', 1.0), (4, 'and', 'puffery', 1.0),
  (5, 'and the', 'hedge', 1.0), (6, 'the of', 'corporate', 1.0), (7, 'that', 'esg_jargon', 1.0), (8, 'with', 'corporate', 1.0), (9, 'of the (dup)', 'esg_jargon', 1.0), (10, 'thing*', 'puffery', 1.0))"""
_ALTERNATIVES = "of  the|in  the|on  the|to  the|for  the|and  the|the  of|thing[a-z0-9]*|that|with|the|and"
_OWNER = """CASE WHEN h = 'the' THEN 0 WHEN h = 'of  the' THEN 1 WHEN h IN ('in  the','on  the','to  the') THEN 2 WHEN h = 'for  the' THEN 3 WHEN h = 'and' THEN 4 WHEN h = 'and  the' THEN 5
  WHEN h = 'the  of' THEN 6 WHEN h = 'that' THEN 7 WHEN h = 'with' THEN 8 ELSE 10 END"""
_COUNTED = f"""
hits AS (SELECT doc_id, trim(unnest(regexp_extract_all(s, ' (?:{_ALTERNATIVES}) '))) AS h FROM canon),
counted AS (SELECT doc_id, {_OWNER} AS term_id, count(*) AS n FROM hits GROUP BY ALL)"""
_TIERS = ("puffery", "hedge", "corporate", "esg_jargon")


def _per(hits: str, words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN round(1000.0::DOUBLE * ({hits}) / {words}, 3) ELSE 0.0::DOUBLE END"


_TIER_SUMS = ", ".join(f"coalesce(sum(n) FILTER (tier = '{t}'), 0)::BIGINT AS {t}_hits" for t in _TIERS)
_ROWS = f"""
totals AS (SELECT doc_id, sum(n)::BIGINT AS hits, sum(n * weight) AS weighted, count(DISTINCT term_id) AS uniq, {_TIER_SUMS} FROM counted JOIN lexicon USING (term_id) GROUP BY doc_id),
rows AS (
  SELECT doc_id, symbol, doc_kind, n_words AS total_words, CAST(n_words < 2000 AS INT) AS short_doc, coalesce(hits, 0) AS buzzword_hits, {_per("coalesce(hits, 0)", "n_words")} AS buzzwords_per_1000_words,
         round(coalesce(weighted, 0.0::DOUBLE), 1) AS buzzword_score_weighted, {_per("coalesce(weighted, 0.0::DOUBLE)", "n_words")} AS weighted_per_1000_words, coalesce(uniq, 0) AS unique_buzzwords,
         {", ".join(f"coalesce({t}_hits, 0) AS {t}_hits" for t in _TIERS)}, {", ".join(f"{_per(f'coalesce({t}_hits, 0)', 'n_words')} AS {t}_per_1000_words" for t in _TIERS)},
         quantity_hits, year_hits, quantity_hits + year_hits AS substance_hits, {_per("quantity_hits + year_hits", "n_words")} AS substance_per_1000_words,
         round(CAST(coalesce(hits, 0) AS DOUBLE) / nullif(quantity_hits + year_hits, 0), 3) AS buzzwords_per_substance_hit
  FROM docs LEFT JOIN totals USING (doc_id))"""


def _used(policy: str) -> str:
    rule = {"auto": "doc_kind <> 'page' OR NOT EXISTS (SELECT 1 FROM docs r WHERE r.symbol = docs.symbol AND r.doc_kind <> 'page')", "reports": "doc_kind <> 'page'", "pages": "doc_kind = 'page'", "main": "doc_kind = 'main'", "all": "true"}[policy]
    return f"\nused AS (SELECT * FROM docs WHERE {rule})"


_COMPANIES = f"""
base AS (
  SELECT symbol, count(*) AS n_docs, string_agg(DISTINCT doc_kind, '; ' ORDER BY doc_kind) AS doc_kinds, sum(n_words)::BIGINT AS total_words, sum(quantity_hits + year_hits)::BIGINT AS substance_hits FROM used GROUP BY symbol),
by_term AS (SELECT symbol, term_id, sum(n)::BIGINT AS n FROM counted JOIN used USING (doc_id) GROUP BY ALL),
sums AS (SELECT symbol, sum(n)::BIGINT AS hits, sum(n * weight) AS weighted, count(DISTINCT term_id) AS uniq, {_TIER_SUMS} FROM by_term JOIN lexicon USING (term_id) GROUP BY symbol),
best AS (SELECT symbol, string_agg(label || ':' || n, '; ' ORDER BY n DESC, term_id) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, term_id) AS k FROM by_term JOIN lexicon USING (term_id)) WHERE k <= 15 GROUP BY symbol),
companies AS (
  SELECT symbol, n_docs, doc_kinds, total_words, coalesce(hits, 0) AS buzzword_hits, {_per("coalesce(hits, 0)", "total_words")} AS buzzwords_per_1000_words, round(coalesce(weighted, 0.0::DOUBLE), 1) AS buzzword_score_weighted,
         {_per("coalesce(weighted, 0.0::DOUBLE)", "total_words")} AS weighted_per_1000_words, coalesce(uniq, 0) AS unique_buzzwords, 0::BIGINT AS extra_hits, {_per("0", "total_words")} AS extra_per_1000_words, substance_hits,
         round(CAST(coalesce(hits, 0) AS DOUBLE) / nullif(substance_hits, 0), 2) AS buzzwords_per_substance_hit, {", ".join(f"{_per(f'coalesce({t}_hits, 0)', 'total_words')} AS {t}_per_1000_words" for t in _TIERS)},
         coalesce(top_terms, '') AS top_terms
  FROM base LEFT JOIN sums USING (symbol) LEFT JOIN best USING (symbol))"""
#: The kept spans with places: tokens before a hit are the blanks before it, halved.
_KEPT = f"""
cut AS (SELECT doc_id, symbol, string_split_regex(s, ' (?:{_ALTERNATIVES}) ') AS gaps, regexp_extract_all(s, ' (?:{_ALTERNATIVES}) ') AS found FROM canon),
each AS (SELECT doc_id, symbol, unnest(found) AS f, unnest(gaps[1:len(found)]) AS g, generate_subscripts(found, 1) AS i FROM cut),
kept AS (
  SELECT doc_id, symbol, trim(f) AS h, len(regexp_extract_all(f, '[^ ]+')) AS length,
         sum(len(regexp_extract_all(g, '[^ ]+'))) OVER w + coalesce(sum(len(regexp_extract_all(f, '[^ ]+'))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
_SLOTS = "\nslots AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS slot FROM (SELECT DISTINCT symbol FROM used))"


def _drop(x: str) -> str:
    for tag in DROP_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{c}')"
    return x


_PAGES = rf"""
lines AS (
  SELECT page_id, i, line FROM (
    SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS line FROM (SELECT page_id, string_split({_drop("html")}, chr(10)) AS l FROM pages))
  WHERE line <> '' AND NOT regexp_matches(line, '(?i){"|".join(BOILERPLATE)}'))"""


def _nav(most: int) -> str:
    return rf"""
nth AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(line) ORDER BY i) AS k, len(regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*')) AS w FROM lines),
cleaned AS (
  SELECT p.page_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.i), '') AS text FROM pages p LEFT JOIN nth n ON n.page_id = p.page_id AND NOT (n.k > {most} AND n.w <= 4) GROUP BY p.page_id),
final AS (SELECT page_id, text, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS BIGINT) AS n_words FROM cleaned)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def all_sql() -> dict[str, str]:
    raw = """
raw AS (
  SELECT doc_id, unnest(list_concat(
    CASE WHEN t0 = 'the' THEN [0] ELSE [] END, CASE WHEN t0 = 'of' AND t1 = 'the' THEN [1, 9] ELSE [] END, CASE WHEN t0 IN ('in', 'on', 'to') AND t1 = 'the' THEN [2] ELSE [] END,
    CASE WHEN t0 = 'for' AND t1 = 'the' THEN [3] ELSE [] END, CASE WHEN t0 = 'and' THEN [4] ELSE [] END, CASE WHEN t0 = 'and' AND t1 = 'the' THEN [5] ELSE [] END,
    CASE WHEN t0 = 'the' AND t1 = 'of' THEN [6] ELSE [] END, CASE WHEN t0 = 'that' AND coalesce(b1, '') <> 'of' THEN [7] ELSE [] END, CASE WHEN t0 = 'with' THEN [8] ELSE [] END,
    CASE WHEN regexp_full_match(t0, 'thing[a-z0-9]*') THEN [10] ELSE [] END)) AS term_id FROM wide)"""
    added = " (?:of  the|in  the|on  the|to  the|for  the|and  the|the  of|(?:with|from)  the|that#?|the[a-z0-9]*|thing[a-z0-9]*|with|and) "
    out = {
        "doc_stats": _with(_DOCS, select="SELECT * FROM docs"),
        "token_vocab": _with(_DOCS, _CANON, _STREAM, select="SELECT row_number() OVER (ORDER BY count(*) DESC, t0) - 1 AS id, t0 AS token, count(*) AS corpus_freq FROM stream GROUP BY t0"),
        "raw_term_hits": _with(_DOCS, _CANON, _STREAM, raw, select="SELECT doc_id, term_id, count(*) AS n FROM raw GROUP BY ALL"),
        "resolved_term_counts": _with(_DOCS, _CANON, _COUNTED, select="SELECT * FROM counted"),
        "term_density_by_source": _with(_DOCS, _CANON, _COUNTED, select=f"SELECT symbol, words, hits, {_per('hits', 'words')} AS density FROM (SELECT symbol, sum(n_words)::BIGINT AS words, coalesce(sum(n), 0)::BIGINT AS hits FROM docs LEFT JOIN (SELECT doc_id, sum(n) AS n FROM counted GROUP BY doc_id) USING (doc_id) GROUP BY symbol)"),
        "doc_scores": _with(_DOCS, _CANON, _COUNTED, _LEXICON, _ROWS, select="SELECT * FROM rows"),
        "doc_percentile": _with(_DOCS, _CANON, _COUNTED, _LEXICON, _ROWS, select="SELECT doc_id, buzzwords_per_1000_words, CASE WHEN count(*) OVER () > 1 THEN round(100.0::DOUBLE * (row_number() OVER (ORDER BY buzzwords_per_1000_words, doc_id) - 1) / (count(*) OVER () - 1), 1) ELSE 0.0::DOUBLE END AS density_percentile FROM rows"),
        "tier_pivot": _with(_DOCS, _CANON, _COUNTED, _LEXICON, select=f"SELECT doc_id, {_TIER_SUMS} FROM counted JOIN lexicon USING (term_id) GROUP BY doc_id"),
        "doc_top_terms": _with(_DOCS, _CANON, _COUNTED, _LEXICON, select="SELECT doc_id, string_agg(label || ':' || n, '; ' ORDER BY k) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term_id) AS k FROM counted JOIN lexicon USING (term_id)) WHERE k <= 3 GROUP BY doc_id"),
        "board_metric_nulls": _with(_DOCS, _CANON, _COUNTED, _LEXICON, _ROWS, select="SELECT doc_id, per_figure FROM (SELECT doc_id, round(CAST(buzzword_hits AS DOUBLE) / nullif(floor(quantity_hits * total_words / 500::DOUBLE), 0), 3) AS per_figure FROM rows) ORDER BY coalesce(per_figure, -1) DESC, doc_id"),
        "doc_full_rows": _with(_DOCS, _CANON, _COUNTED, _LEXICON, _ROWS, """
best AS (SELECT doc_id, string_agg(label || ':' || n, '; ' ORDER BY k) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term_id) AS k FROM counted JOIN lexicon USING (term_id)) WHERE k <= 10 GROUP BY doc_id)""", select="""
SELECT r.*, d.file, 'Company ' || substr(r.symbol, 4) AS company, coalesce(b.top_terms, '') AS top_terms,
  CASE WHEN count(*) OVER () > 1 THEN round(100.0::DOUBLE * (row_number() OVER (ORDER BY r.buzzwords_per_1000_words, d.file) - 1) / (count(*) OVER () - 1), 1) ELSE 0.0::DOUBLE END AS density_percentile
FROM rows r JOIN docs d USING (doc_id) LEFT JOIN best b USING (doc_id)"""),
        "find_by_symbol": _with(_DOCS, _CANON, _STREAM, select="SELECT symbol, count(*) AS hits FROM wide JOIN src USING (doc_id) WHERE t0 IN ('in', 'of') AND t1 = 'the' GROUP BY symbol ORDER BY hits DESC, symbol LIMIT 15"),
        "wildcard_terms": _with(_DOCS, _CANON, _STREAM, select="SELECT doc_id, term_id, count(*) AS n FROM (SELECT doc_id, 0 AS term_id FROM wide WHERE regexp_full_match(t0, 'th[a-z0-9]*ing') UNION ALL SELECT doc_id, 1 FROM wide WHERE t0 IN ('the', 'this') AND regexp_full_match(t1, 'th[a-z0-9]*')) GROUP BY ALL"),
        "lookaround_terms": _with(_DOCS, _CANON, _STREAM, select="SELECT doc_id, term_id, count(*) AS n FROM (SELECT doc_id, 0 AS term_id FROM wide WHERE t0 = 'the' AND coalesce(b1, '') <> 'of' AND NOT (coalesce(b2, '') = 'and' AND coalesce(b1, '') = 'in') UNION ALL SELECT doc_id, 1 FROM wide WHERE t0 = 'and' AND coalesce(t1, '') <> 'the' AND NOT (coalesce(t1, '') = 'of' AND coalesce(t2, '') = 'that')) GROUP BY ALL"),
        "added_word_stats": _with(_DOCS, _CANON, _STREAM, f"\nfound AS (SELECT trim(unnest(regexp_extract_all(s, '{added}'))) AS h FROM canon)", select="""
SELECT 'the*' AS term, a AS corpus_hits, b AS new_hits, a - b AS already_counted FROM (SELECT count(*) AS a FROM stream WHERE regexp_full_match(t0, 'the[a-z0-9]*')), (SELECT count(*) AS b FROM found WHERE regexp_full_match(h, 'the[a-z0-9]+'))
UNION ALL SELECT 'with|from the', a, b, a - b FROM (SELECT count(*) AS a FROM wide WHERE t0 IN ('with', 'from') AND t1 = 'the'), (SELECT count(*) AS b FROM found WHERE h IN ('with  the', 'from  the'))"""),
        "concordance": _with(_DOCS, _CANON, _STREAM, """
found AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, count(*) OVER () AS n FROM wide WHERE t0 = 'of' AND t1 = 'the'),
picked AS (SELECT * FROM found WHERE place % greatest(1, n // 20) = 0 AND place < 20 * greatest(1, n // 20))""", select="""
SELECT doc_id, pos AS start, array_to_string(list_transform(toks[greatest(pos - 8, 1):pos], lambda t: CASE WHEN t = '@' THEN '·' ELSE t END), ' ') AS before,
  array_to_string(toks[pos + 1:pos + 2], ' ') AS hit, array_to_string(list_transform(toks[pos + 3:pos + 11], lambda t: CASE WHEN t = '@' THEN '·' ELSE t END), ' ') AS after FROM picked JOIN listed USING (doc_id)"""),
        "resolve_company": """
WITH c AS (SELECT DISTINCT source AS symbol, 'company ' || substr(source, 4) AS name, source || '.example' AS site FROM documents),
q(query) AS (VALUES ('src1'), ('SRC10'), ('company 7'), ('src3.example'), ('comp'), ('rc1'), ('ample'), ('zzz')),
f AS (SELECT query, symbol, CASE WHEN symbol = lower(query) THEN 0 WHEN site = lower(query) THEN 1 WHEN name = lower(query) THEN 2 WHEN starts_with(symbol, lower(query)) THEN 3
  WHEN starts_with(name, lower(query)) OR starts_with(site, lower(query)) THEN 4 WHEN contains(name, lower(query)) OR contains(site, lower(query)) THEN 5 ELSE 99 END AS fit FROM c, q)
SELECT query, symbol, CAST(fit AS INT) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fit, symbol) AS k FROM f WHERE fit < 99) WHERE k = 1""",
        "page_clean_lines": _with(_PAGES, select="SELECT p.page_id, count(l.line) AS n_lines, coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '') AS text FROM pages p LEFT JOIN lines l ON l.page_id = p.page_id GROUP BY p.page_id"),
        "page_dedup_nav": _with(_PAGES, _nav(1), select="SELECT * FROM final"),
        "page_min_words": _with(_PAGES, _nav(2), select="SELECT page_id, n_words, CAST(n_words < 150 AS INT) AS too_short FROM final"),
        "todo_antijoin": _with(_DOCS, select="SELECT file FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs c WHERE c.file = d.file AND c.doc_kind = 'main')"),
        "docs_by_kind": _with(_DOCS, select="SELECT doc_kind, count(*) AS n FROM docs GROUP BY doc_kind"),
        "lexicon_tiers": _with(_LEXICON, select="SELECT tier, count(*) AS n FROM lexicon GROUP BY tier"),
        "sparse_vectors": _with(_DOCS, _CANON, _COUNTED, _used("auto"), _SLOTS, select="SELECT term_id, string_agg(printf('%x', slot) || ':' || printf('%x', n), ',' ORDER BY slot) AS c FROM (SELECT term_id, slot, sum(n)::BIGINT AS n FROM counted JOIN used USING (doc_id) JOIN slots USING (symbol) GROUP BY ALL) GROUP BY term_id"),
        "unclaimed_words": _with(_DOCS, _CANON, _STREAM, _KEPT, _used("auto"), _SLOTS, """
taken AS (SELECT DISTINCT doc_id, start + unnest(range(length)) AS pos FROM kept),
often AS (SELECT t0 FROM stream WHERE regexp_full_match(t0, '[a-z]{3,20}') GROUP BY t0 HAVING count(*) >= 4),
placed AS (SELECT t0, slot, count(*) AS n, count(*) FILTER (t.pos IS NULL) AS free FROM stream s JOIN used USING (doc_id) JOIN slots USING (symbol) JOIN often USING (t0) LEFT JOIN taken t ON t.doc_id = s.doc_id AND t.pos = s.pos GROUP BY ALL)""", select="""
SELECT t0 AS token, string_agg(printf('%x', slot) || ':' || printf('%x', n), ',' ORDER BY slot) AS c,
  CASE WHEN sum(n - free) > 0 THEN coalesce(string_agg(printf('%x', slot) || ':' || printf('%x', free), ',' ORDER BY slot) FILTER (free > 0), '') END AS n, sum(n - free)::BIGINT AS overlap FROM placed GROUP BY t0"""),
    }
    chain = (_DOCS, _CANON, _COUNTED, _LEXICON)
    for policy in ("auto", "reports", "pages", "main", "all"):
        out[f"sources_{policy}"] = _with(*chain, _used(policy), _COMPANIES, select="SELECT * FROM companies")
    auto = (*chain, _used("auto"), _COMPANIES)
    out["company_top_terms"] = _with(*auto, select="SELECT symbol, top_terms FROM companies")
    out["company_all_terms"] = _with(*auto, select="SELECT symbol, coalesce(t.all_terms, '') AS all_terms FROM base LEFT JOIN (SELECT symbol, string_agg(label || ':' || n, '; ' ORDER BY n DESC, term_id) AS all_terms FROM by_term JOIN lexicon USING (term_id) GROUP BY symbol) t USING (symbol)")
    out["company_board"] = _with(*auto, select="SELECT symbol, 'Company ' || substr(symbol, 4) AS company, symbol || '.example' AS website, 'sector ' || (CAST(substr(symbol, 4) AS INT) % 3) AS sector, total_words, buzzword_hits, buzzwords_per_1000_words FROM companies WHERE total_words >= 2000 ORDER BY buzzwords_per_1000_words DESC, symbol LIMIT 10")
    out["lookup_rank"] = _with(*auto, select="""
SELECT symbol, total_words, buzzwords_per_1000_words, rank, of FROM companies LEFT JOIN (SELECT symbol, row_number() OVER (ORDER BY buzzwords_per_1000_words DESC, symbol) AS rank, count(*) OVER () AS of FROM companies WHERE total_words >= 2000) USING (symbol)""")
    out["quintile"] = _with(*auto, select="SELECT symbol, buzzwords_per_1000_words, CAST(ntile(5) OVER (ORDER BY buzzwords_per_1000_words, symbol) AS INT) AS quintile FROM companies WHERE total_words >= 2000")
    return out
