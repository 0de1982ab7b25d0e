"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, html, jaccard, mixing, packing, quality, rules, runs, substrings, toxicity, urls, warc
from .common import table

URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "tail_probability", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_repeats(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' records in which some, chosen by the MD5 of their ids, are altered, cut or missing."""
    pages = table(spark, sf_dir, "pages")
    kind = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    half = F.floor(F.length("html") / 2).cast("int")
    altered = F.concat(F.substring("html", 1, half), F.lit("~"), F.expr("substring(html, int(floor(length(html) / 2)) + 2)"))
    body = F.when(kind.isin("00", "01", "02"), altered).when(kind == "03", F.substring("html", 1, half)).otherwise(F.col("html"))
    copy = F.sha2(F.encode(warc.record_text(F.col("page_id"), F.col("url"), F.coalesce(body, F.lit(""))), "utf-8"), 256)
    held = warc.manifest(pages, copy=F.when(kind != "04", copy))
    found = warc.audit(held.drop("copy_digest"), held.where("copy_digest is not null").select("file", "place", F.col("copy_digest").alias("digest")))
    return found.drop("replica_offset", "replica_length")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents' words, of which those whose id's CRC-32 is a multiple of ten are made periodic at their end first."""
    return runs.detect_runs(table(spark, sf_dir, "documents"), plant=True)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out quarter of ids."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rated = toxicity.rate_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out))
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_url_filters, op3_substring_dedup, op4_best_fit_packing, op5_document_fingerprints, op6_html_extraction,
        op7_quality_rules, op8_source_mixing, op9_warc_fixity, op10_ngram_jaccard_join, op11_periodic_runs, op12_toxicity, op13_tokenizer_alignment,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# urls: rules, then classes of aliases by reachability over canonical links and redirects
_HOST = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.action} {r.text}'" for r in sorted(URL_RULES, key=lambda r: -len(r.text))
)
_Q = "'" * 2  # a quote within SQL text


def _node(url: str) -> str:
    """A url without fragment, dot segments, default port and needless escapes, scheme and host in lower case; null without ://."""
    code = "upper(substr(x, 1, 2))"
    escapes = f"list_transform(string_split(bare, '%')[2:], lambda x: CASE WHEN regexp_matches({code}, '{urls._UNRESERVED}') THEN chr(CAST('0x' || {code} AS INT)) WHEN regexp_matches({code}, '^[0-9A-F]{{2}}$') THEN '%' || {code} ELSE '%' || substr(x, 1, 2) END || substr(x, 3))"
    clean = f"(SELECT string_split(bare, '%')[1] || array_to_string({escapes}, '') FROM (SELECT regexp_replace({url}, '(?s)#.*$', '') AS bare))"
    return f"(SELECT {_parts('clean')} FROM (SELECT {clean} AS clean))"


def _parts(clean: str) -> str:
    path = f"regexp_extract({clean}, '(?s)^.*?://[^/?]*([^?]*)', 1)"
    climb = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({p}, '/')[2:], lambda x: [x])), lambda done, x: CASE WHEN x[1] = '..' THEN done[1:len(done) - 1] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END)"
    flat = f"CASE WHEN regexp_matches({path}, '/[.][.]?(/|$)') THEN '/' || array_to_string(list_concat({climb.format(p=path)}, CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN [''] ELSE CAST([] AS VARCHAR[]) END), '/') ELSE {path} END"
    head = f"translate(regexp_extract({clean}, '(?s)^(.*?://[^/?]*)', 1), '{_UPPER}', '{_LOWER}')"
    head = f"regexp_replace(regexp_replace({head}, '^(http://.*):(80)?$', '\\1'), '^(https://.*):(443)?$', '\\1')"
    return f"CASE WHEN contains({clean}, '://') THEN {head} || CASE WHEN {path} = '' THEN '/' ELSE {flat} END || regexp_extract({clean}, '(?s)([?].*)$', 1) END"


def _decoded(text: str) -> str:
    number = "CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN chr(CAST(n AS INT)) ELSE chr(65533) END"
    after = "regexp_replace(x, '(?s)^[^;]*;', '')"
    named = " ".join(f"WHEN starts_with(x, '{name};') THEN '{sign.replace(chr(39), chr(39) * 2)}' || {after}" for name, sign in urls._NAMED.items())
    dec = number.replace("n ", "CAST(regexp_extract(x, '^#([0-9]{1,7});', 1) AS BIGINT) ")
    hexa = number.replace("n ", "CAST('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]{1,6});', 1) AS BIGINT) ")
    piece = f"CASE WHEN regexp_matches(x, '^#[0-9]{{1,7}};') THEN {dec} || {after} WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]{{1,6}};') THEN {hexa} || {after} {named} ELSE '&' || x END"
    return f"string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda x: {piece}), '')"


def _value(name: str) -> str:
    pattern = urls._attribute(name).replace("'", _Q)
    text = "(" + " || ".join(f"regexp_extract(t, '{pattern}', {k})" for k in (1, 2, 3)) + ")"
    return _decoded(f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')")


def _url(name: str) -> str:
    return f"trim(regexp_replace({_value(name)}, '[\\t\\n\\r]', '', 'g'), chr(32) || chr(12))"


def _resolved(target: str, base: str) -> str:
    bare, root, path = f"regexp_replace({target}, '(?s)#.*$', '')", f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    folder = f"CASE WHEN contains({path}, '/') THEN regexp_extract({path}, '(?s)^(.*/)', 1) ELSE '/' END"
    return (
        f"CASE WHEN {bare} = '' OR {bare} IS NULL THEN NULL WHEN regexp_matches({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {bare} WHEN starts_with({bare}, '//') THEN regexp_extract({base}, '(?s)^(.*?):', 1) || ':' || {bare} "
        f"WHEN regexp_matches({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({bare}, '/') THEN {root} || {bare} WHEN starts_with({bare}, '?') THEN {root} || {path} || {bare} ELSE {root} || {folder} || {bare} END"
    )


_TAGS = urls._TAG.replace("'", _Q)
_OP2 = rf"""WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN regexp_replace(url, '(?s)^.*?://', '') ELSE '' END AS rest FROM pages),
t0 AS (SELECT row_number() OVER () AS r, url, regexp_extract_all(regexp_replace(html, '(?is){urls._UNREAD}', ' ', 'g'), '{_TAGS}') AS tags FROM p WHERE regexp_matches(html, '(?i)canonical|refresh')),
t1 AS (SELECT r, url, unnest(tags) AS t, generate_subscripts(tags, 1) AS k FROM t0),
b0 AS (SELECT r, {_url("href")} AS href, k FROM t1 WHERE regexp_matches(t, '(?i)^<base')),
b1 AS (SELECT r, arg_min(href, k) AS href FROM b0 WHERE href <> '' GROUP BY r),
l0 AS (SELECT r, url, {_url("href")} AS target FROM t1 WHERE regexp_matches(t, '(?i)^<link') AND regexp_matches({_value("rel")}, '(?i)(^|\s)canonical(\s|$)')
 UNION ALL SELECT r, url, CASE WHEN regexp_matches({_value("content")}, '{urls._NOWHERE.replace("'", _Q)}') THEN '' ELSE regexp_extract({_value("content")}, '{urls._REFRESH.replace("'", _Q)}', 1) END FROM t1 WHERE regexp_matches(t, '(?i)^<meta') AND regexp_matches({_value("http-equiv")}, '(?i)^refresh$')),
l1 AS (SELECT l0.url, l0.target, coalesce({_resolved("b1.href", "l0.url")}, l0.url) AS base FROM l0 LEFT JOIN b1 ON b1.r = l0.r),
l2 AS (SELECT url, {_resolved("target", "base")} AS target FROM l1),
l AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM l2 WHERE contains(target, '://')),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a AS n, a AS m FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m),
u AS (SELECT DISTINCT n AS url FROM reach), uh AS (SELECT url, regexp_replace(url, '(?s)^.*?://', '') AS rest FROM u), ur AS (SELECT url, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM uh),
uv AS (SELECT url, CASE {_FITS} END AS fit FROM ur),
bad AS (SELECT reach.n AS url FROM reach JOIN uv ON uv.url = reach.m GROUP BY reach.n HAVING count(*) FILTER (WHERE starts_with(fit, 'block')) > 0 AND count(*) FILTER (WHERE starts_with(fit, 'allow')) = 0),
h AS (SELECT page_id, {_node("url")} AS node, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
v AS (SELECT *, CASE {_FITS} END AS fit FROM h)
SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN substr(fit, 7) END AS rule, CASE WHEN fit IS NOT NULL THEN substr(fit, 1, 5) WHEN node IN (SELECT url FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM v"""

_OP3 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35), x AS (SELECT n.r, n.i, sha256(array_to_string(list_slice(w, n.i, n.i + 34), ' ')) AS h FROM n JOIN d ON d.r = n.r),
t AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1), c AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM x WHERE h IN (SELECT h FROM t)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_transform(w, lambda y, k: CASE WHEN list_contains(gone, k) THEN NULL ELSE y END), lambda y: y IS NOT NULL), lambda y: y) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""

_OP9 = r"""WITH k AS (SELECT page_id, url, html, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS kind, CAST(floor(length(html) / 2.0) AS INT) AS half FROM pages),
b AS (SELECT *, CASE WHEN kind IN ('00', '01', '02') THEN substr(html, 1, half) || '~' || substr(html, half + 2) WHEN kind = '03' THEN substr(html, 1, half) ELSE html END AS held FROM k),
r AS (SELECT page_id, kind, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
 html, held FROM b),
c AS (SELECT page_id, kind, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec, head || strlen(held) || chr(13) || chr(10) || chr(13) || chr(10) || held || chr(13) || chr(10) || chr(13) || chr(10) AS rep FROM r),
s AS (SELECT page_id, page_id // 1000 AS file, strlen(rec) AS length, sha256(rec) AS digest, CASE WHEN kind = '04' THEN 'missing' ELSE sha256(rep) END AS replica_digest FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS place, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM s)
SELECT file, place, "offset", length, page_id, digest, replica_digest FROM o WHERE digest <> replica_digest"""

_OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS n, a AS m FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m), k AS (SELECT n, min(m) AS c FROM reach GROUP BY n)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(k.c, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.n = d.doc_id"""

ORACLES: dict[str, str] = {"op2_url_filters": _OP2, "op3_substring_dedup": _OP3, "op9_warc_fixity": _OP9, "op10_ngram_jaccard_join": _OP10}
