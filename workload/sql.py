"""Building blocks of the DuckDB SQL: each block is a list of named subqueries."""

from __future__ import annotations

from collections.abc import Callable

from wartalens.functions import html, roots, stemming, text
from workload import views


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sub(column: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({column}, {lit(pattern)}, {lit(replacement)}, 'g')"


def strip_emoji(c: str) -> str:
    return sub(c, text.EMOJI, " ")


def fold(c: str) -> str:
    out = f"translate({c}, {lit(text.FOLD_FROM)}, {lit(text.FOLD_TO)})"
    for sign, ascii_form in (text.SIGN_FOLDS | text.LONG_FOLDS).items():
        out = f"replace({out}, {lit(sign)}, {lit(ascii_form)})"
    return sub(out, text.COMBINING, "")


def strip_urls(c: str) -> str:
    return sub(c, "(?i)(?:" + text.URL + ")", " ")


def strip_entities(c: str) -> str:
    return sub(c, "(?i)(?:" + "|".join(text.ENTITIES) + ")", " ")


WHITESPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def lower_trim(c: str) -> str:
    return f"trim(lower({c}), {WHITESPACE})"


def strip_lead(c: str) -> str:
    return f"regexp_replace({c}, {lit('(?i)' + text.LEAD_PATTERN + text.LEAD_TAIL)}, '')"


def strip_clock(c: str) -> str:
    return sub(c, "(?i)" + text.CLOCK, " ")


def strip_html_words(c: str) -> str:
    return sub(c, r"(?i)\b(?:" + "|".join(text.HTML_WORDS) + r")\b", " ")


def keep_letters(c: str) -> str:
    return sub(c, text.NOT_LETTERS, " ")


def squeeze(c: str) -> str:
    return f"trim({sub(c, text.SPACES, ' ')})"


def clean(c: str) -> str:
    c = fold(strip_emoji(f"coalesce({c}, '')"))
    c = strip_lead(lower_trim(strip_entities(strip_urls(c))))
    return squeeze(keep_letters(strip_html_words(strip_clock(c))))


def stem(c: str) -> str:
    for pattern, replacement in stemming.RULES:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(replacement)})"
    return c


def root_stems(tokens: str, known: str) -> str:
    """``root_stems(token, stem)`` from ``tokens(token)`` and ``known(root)``: look-ups step by step, first found wins."""
    def prefixed(source: str, level: int) -> str:
        rules = []
        for nth, (pattern, forms) in enumerate(roots.PREFIXES):
            options = ", ".join(f"regexp_replace(form, {lit(pattern)}, {lit(f.replace('$1', chr(92) + '1'))})" for f in forms)
            rules.append(f"WHEN regexp_matches(form, {lit(pattern)}) THEN [{options}]")
        same = "list_filter(more, lambda x: substr(x, 1, 2) <> substr(form, 1, 2))" if level > 1 else "more"
        return f"""forms{level} AS MATERIALIZED (
  SELECT token, base, path || [i] AS path, more[i] AS form FROM (
    SELECT token, base, path, {same} AS more, unnest(range(1, len({same}) + 1)) AS i FROM (
      SELECT token, base, path, form, list_filter(CASE {' '.join(rules)} ELSE CAST([] AS VARCHAR[]) END,
        lambda x: length(x) >= {roots.SHORTEST}) AS more FROM {source})))"""

    def off(column: str, pattern: str) -> str:
        shorter = f"regexp_replace({column}, {lit(pattern)}, '')"
        return f"CASE WHEN length({shorter}) >= {roots.SHORTEST} THEN {shorter} ELSE {column} END"

    forbidden = " OR ".join(f"(suffix = {lit(s)} AND regexp_matches(token, {lit(p)}))" for s, p in roots.FORBIDDEN)
    return f"""bare_words AS (SELECT token, {off('token', roots.PARTICLE)} AS bare FROM {tokens}),
own_words AS (SELECT *, {off('bare', roots.POSSESSIVE)} AS own FROM bare_words),
core_words AS (SELECT *, {off('own', roots.DERIVED)} AS core FROM own_words),
parted AS MATERIALIZED (SELECT *, substr(own, length(core) + 1) AS suffix FROM core_words WHERE length(token) > {roots.SHORTEST}),
bases AS MATERIALIZED (
  SELECT token, 0 AS base, core AS form FROM parted WHERE NOT ({forbidden})
  UNION ALL SELECT token, 1, core || 'k' FROM parted
    WHERE suffix = 'kan' AND NOT regexp_matches(token, {lit(dict(roots.FORBIDDEN)['an'])})
  UNION ALL SELECT token, 2, own FROM parted UNION ALL SELECT token, 3, bare FROM parted UNION ALL SELECT token, 4, token FROM parted),
forms0 AS (SELECT token, base, CAST([] AS BIGINT[]) AS path, form FROM bases),
{prefixed('forms0', 1)},
{prefixed('forms1', 2)},
{prefixed('forms2', 3)},
looked_up AS (
  SELECT token, token AS form, [0, 0] AS place FROM {tokens}
  UNION ALL SELECT token, bare, [0, 1] FROM parted UNION ALL SELECT token, own, [0, 2] FROM parted
  UNION ALL SELECT token, form, [0, 3 + base] FROM bases WHERE base < 2
  UNION ALL SELECT token, form, [1 + base, len(path)] || path FROM (
    SELECT * FROM forms1 UNION ALL SELECT * FROM forms2 UNION ALL SELECT * FROM forms3)),
root_stems AS (
  SELECT t.token, coalesce(f.stem, t.token) AS stem FROM {tokens} t LEFT JOIN (
    SELECT token, arg_min(form, place) AS stem FROM looked_up WHERE form IN (SELECT root FROM {known}) GROUP BY token) f USING (token))"""


ARTICLES = f"""articles AS MATERIALIZED (
  SELECT doc_id AS article_id, source AS portal, 'Artikel ' || doc_id AS title,
    try_cast(CASE WHEN doc_id % 83 = 0 THEN 'n/a'
      ELSE strftime(DATE '2025-06-01' + CAST(doc_id % 61 AS INTEGER), '%Y-%m-%d') END AS DATE) AS released,
    CASE WHEN doc_id % 101 = 0 THEN NULL ELSE 'https://x.example/' || md5(text) END AS url,
    CASE WHEN doc_id % 97 = 0 THEN NULL
      WHEN doc_id % 3 = 0 THEN {lit(views.LEAD_IN)} || text || {lit(views.LEAD_OUT)}
      WHEN doc_id % 3 = 1 THEN {lit(views.DETIK_IN)} || text || {lit(views.DETIK_OUT)}
      ELSE text END AS content,
    CASE WHEN doc_id % 89 = 0 THEN NULL ELSE n_chars END AS content_len, lang
  FROM documents)"""

STOP = words(views.STOPWORDS)


def tokens_of(source: str, key: str, column: str, keep: str = "", stemmed: Callable[[str], str] = stem) -> str:
    """``docs(doc_id, ..., tokens)`` from a source table."""
    extra = f", {keep}" if keep else ""
    return f"""split_up AS MATERIALIZED (
  SELECT {key} AS doc_id{extra}, {clean(column)} AS c FROM {source}),
word_rows AS (
  SELECT doc_id, unnest(list_filter(string_split(c, ' '), lambda t: length(t) > 1)) AS w,
    generate_subscripts(list_filter(string_split(c, ' '), lambda t: length(t) > 1), 1) AS p FROM split_up),
stems AS MATERIALIZED (
  SELECT w, {stemmed('w')} AS s FROM (SELECT DISTINCT w FROM word_rows WHERE w NOT IN {STOP})),
docs AS MATERIALIZED (
  SELECT d.doc_id{extra}, coalesce(g.tokens, []) AS tokens FROM split_up d LEFT JOIN (
    SELECT doc_id, list(s ORDER BY p) AS tokens FROM word_rows JOIN stems USING (w)
    WHERE s NOT IN {STOP} GROUP BY doc_id) g USING (doc_id)),
flat AS MATERIALIZED (
  SELECT doc_id{extra}, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM docs)"""


DOCS = ARTICLES + ",\n" + tokens_of("articles", "article_id", "content", "lang")

FREQ = """freq AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM flat GROUP BY term)"""
VOCAB = FREQ + """,
vocab AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, term, df, cf FROM freq
  WHERE df >= 12 AND df <= floor(0.5 * (SELECT count(*) FROM docs))
  ORDER BY df DESC, term LIMIT 100000)"""
BOW = VOCAB + """,
bow AS MATERIALIZED (
  SELECT doc_id, lang, term_id, term, count(*) AS tf FROM flat JOIN vocab USING (term) GROUP BY ALL)"""
PHI = DOCS + ",\n" + BOW + """,
topics AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS topic_id FROM (SELECT DISTINCT lang FROM documents)),
phi AS MATERIALIZED (
  SELECT topic_id, term, n / sum(n) OVER (PARTITION BY topic_id) AS prob
  FROM (SELECT topic_id, term, CAST(sum(tf) AS BIGINT) AS n FROM bow JOIN topics USING (lang) GROUP BY ALL)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY prob DESC, term) AS rank FROM phi)"""
THETA = PHI + """,
raw_theta AS (SELECT doc_id, topic_id, sum(tf * prob) AS w FROM bow JOIN phi USING (term) GROUP BY ALL),
theta AS MATERIALIZED (
  SELECT d.doc_id, t.topic_id,
    round(coalesce(r.w, 0) / sum(coalesce(r.w, 0)) OVER (PARTITION BY d.doc_id), 9) AS prob
  FROM (SELECT DISTINCT doc_id FROM bow) d, topics t LEFT JOIN raw_theta r ON r.doc_id = d.doc_id AND r.topic_id = t.topic_id),
theta_ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, topic_id) AS rank FROM theta),
dominant AS (SELECT doc_id, topic_id, prob FROM theta_ranked WHERE rank = 1)"""
SIZES = THETA + """,
lengths AS (SELECT doc_id, sum(tf) AS length FROM bow GROUP BY doc_id),
sizes AS MATERIALIZED (SELECT topic_id, sum(prob * length) AS weight FROM theta JOIN lengths USING (doc_id) GROUP BY topic_id),
frequencies AS MATERIALIZED (
  SELECT term, sum(prob * weight) AS frequency, sum(prob * weight) / (SELECT sum(weight) FROM sizes) AS p_term
  FROM phi JOIN sizes USING (topic_id) GROUP BY term)"""


def counted(prefix: str, source: str, outer: bool = False) -> str:
    """``<prefix>counts`` and ``<prefix>scored`` of words and adjacent pairs of a ``(doc_id, pos, term)`` table.

    ``outer`` scores a pair by its first and last plain word, with counts by the joined form.
    """
    scored = f"""{prefix}forms AS MATERIALIZED (SELECT replace(ngram, ' ', '_') AS form, CAST(sum(n) AS BIGINT) AS n FROM {prefix}counts GROUP BY 1),
{prefix}scored AS (
  SELECT split_part(p.ngram, ' ', 1) AS left_word, split_part(p.ngram, ' ', 2) AS right_word, f.n AS n_ab, a.n AS n_a, b.n AS n_b,
    (f.n - 10) / a.n / b.n * (SELECT count(*) FROM {prefix}forms) AS score
  FROM {prefix}counts p JOIN {prefix}forms f ON f.form = replace(p.ngram, ' ', '_')
    JOIN {prefix}forms a ON a.form = split_part(f.form, '_', 1) JOIN {prefix}forms b ON b.form = split_part(f.form, '_', -1)
  WHERE contains(p.ngram, ' ')),""" if outer else f"""{prefix}scored AS (
  SELECT a.ngram AS left_word, b.ngram AS right_word, p.n AS n_ab, a.n AS n_a, b.n AS n_b,
    (p.n - 10) / a.n / b.n * (SELECT count(*) FROM {prefix}counts) AS score
  FROM {prefix}counts p JOIN {prefix}counts a ON a.ngram = split_part(p.ngram, ' ', 1)
    JOIN {prefix}counts b ON b.ngram = split_part(p.ngram, ' ', 2)
  WHERE contains(p.ngram, ' ')),"""
    return f"""{prefix}pairs AS MATERIALIZED (
  SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM {source}),
{prefix}counts AS MATERIALIZED (
  SELECT ngram, count(*) AS n FROM (
    SELECT term AS ngram FROM {source} UNION ALL
    SELECT term || ' ' || following FROM {prefix}pairs WHERE following IS NOT NULL) GROUP BY ngram),
{scored}
{prefix}phrases AS MATERIALIZED (SELECT * FROM {prefix}scored WHERE score > 10)"""


def merged(prefix: str, source: str, phrases: str, target: str) -> str:
    """``target(doc_id, pos, term)``: runs of marked positions, heads at even offsets of a run."""
    return f"""{prefix}next AS (
  SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM {source}),
{prefix}marked AS (
  SELECT n.*, p.left_word IS NOT NULL AS is_mark
  FROM {prefix}next n LEFT JOIN {phrases} p ON p.left_word = n.term AND p.right_word = n.following),
{prefix}runs AS (
  SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM {prefix}marked WHERE is_mark),
{prefix}heads AS (
  SELECT doc_id, pos FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, run) AS start FROM {prefix}runs)
  WHERE (pos - start) % 2 = 0),
{target} AS MATERIALIZED (
  SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pos) - 1 AS pos,
    CASE WHEN h.pos IS NOT NULL THEN m.term || '_' || m.following ELSE m.term END AS term
  FROM {prefix}marked m LEFT JOIN {prefix}heads h ON h.doc_id = m.doc_id AND h.pos = m.pos
    LEFT JOIN {prefix}heads t ON t.doc_id = m.doc_id AND t.pos + 1 = m.pos
  WHERE t.pos IS NULL)"""


PHRASES = (
    counted("bi_", "flat") + ",\n" + merged("m1_", "flat", "bi_phrases", "flat_bi") + ",\n"
    + counted("tri_", "flat_bi", outer=True) + ",\n" + merged("m2_", "flat_bi", "tri_phrases", "flat_tri")
)
PHRASED = DOCS + ",\n" + PHRASES


def window_counts(width: int) -> str:
    """Single, pair and window counts from merged start ranges of the top-20 terms."""
    return PHI + f""",
tops AS (SELECT topic_id, rank, term FROM ranked WHERE rank <= 20),
sizes_of AS (SELECT doc_id, len(tokens) AS n FROM docs),
occ AS MATERIALIZED (
  SELECT f.doc_id, f.term, greatest(0, f.pos - {width - 1}) AS lo, least(f.pos, greatest(0, s.n - {width})) AS hi
  FROM flat f JOIN sizes_of s USING (doc_id) WHERE f.term IN (SELECT term FROM tops)),
flagged AS (
  SELECT *, CASE WHEN lo > 1 + coalesce(max(hi) OVER (PARTITION BY doc_id, term ORDER BY hi, lo
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10) THEN 1 ELSE 0 END AS fresh FROM occ),
islands AS MATERIALIZED (
  SELECT doc_id, term, min(lo) AS lo, max(hi) AS hi FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, term ORDER BY hi, lo ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
  GROUP BY doc_id, term, island),
total AS (SELECT sum(greatest(1, n - {width} + 1)) AS n FROM sizes_of
  WHERE doc_id IN (SELECT doc_id FROM occ)),
joint AS MATERIALIZED (
  SELECT a.term AS a, b.term AS b, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS n
  FROM islands a JOIN islands b ON a.doc_id = b.doc_id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL),
""" + GRID


def document_counts() -> str:
    return PHI + """,
tops AS (SELECT topic_id, rank, term FROM ranked WHERE rank <= 20),
occ AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM flat WHERE term IN (SELECT term FROM tops)),
total AS (SELECT count(*) AS n FROM docs),
joint AS MATERIALIZED (
  SELECT a.term AS a, b.term AS b, count(*) AS n FROM occ a JOIN occ b USING (doc_id) GROUP BY ALL),
""" + GRID


GRID = """grid AS MATERIALIZED (
  SELECT x.topic_id, x.rank AS rank_a, y.rank AS rank_b, x.term AS w_a, y.term AS w_b,
    sa.n / (SELECT n FROM total) AS p_a, sb.n / (SELECT n FROM total) AS p_b,
    coalesce(j.n, 0) / (SELECT n FROM total) AS p_ab
  FROM tops x JOIN tops y USING (topic_id)
    JOIN joint sa ON sa.a = x.term AND sa.b = x.term JOIN joint sb ON sb.a = y.term AND sb.b = y.term
    LEFT JOIN joint j ON j.a = x.term AND j.b = y.term),
valued AS MATERIALIZED (
  SELECT *, ln((p_ab + 1e-12) / (p_a * p_b)) AS pmi,
    ln((p_ab + 1e-12) / (p_a * p_b)) / -ln(p_ab + 1e-12) AS npmi FROM grid)"""


def extracted() -> str:
    """``texts(page_id, content)`` from pages: tokens of a page as rows, paragraphs by running counts."""
    names = ", ".join(f"{lit(n)}: {lit(c)}" for n, c in html.NAMED.items())
    windows = ", ".join(f"{byte}: {lit(c)}" for byte, c in html.WINDOWS.items())
    edges = f"{WHITESPACE} || chr(160)"
    number = "CASE WHEN regexp_matches(r, '^#[xX]') THEN CAST(('0x' || substr(r, 3)) AS BIGINT) ELSE CAST(substr(r, 2) AS BIGINT) END"
    char = (f"CASE WHEN r LIKE '#%' THEN list_transform([{number}], lambda v: CASE WHEN v BETWEEN 55296 AND 57343 THEN chr(65533) "
            "WHEN v BETWEEN 1 AND 1114111 THEN coalesce(windows[CAST(v AS INTEGER)], chr(CAST(v AS INTEGER))) END)[1] ELSE entities[r] END")

    def front(pattern: str) -> str:
        return (f"list_transform([regexp_extract(piece, {lit(pattern)}, 1)], lambda f: list_transform([rtrim(f, ';')], lambda r: "
                f"CASE WHEN f <> '' THEN ({char}) || substr(piece, length(f) + 1) END)[1])[1]")

    piece = f"coalesce({front(html.REFERENCE)}, {front(html.OLD_NAME)}, '&' || piece)"
    decoded = f"array_to_string(list_transform(string_split(token, '&'), lambda piece, i: CASE WHEN i = 1 THEN piece ELSE {piece} END), '')"
    return f"""tokens AS (
  SELECT page_id, unnest(found) AS token, generate_subscripts(found, 1) AS nth
  FROM (SELECT page_id, regexp_extract_all(html, {lit(html.token_pattern(False))}) AS found FROM pages)),
kinds AS MATERIALIZED (
  SELECT page_id, nth, token, CASE WHEN NOT regexp_matches(token, {lit(html.IS_TAG)}) THEN 'text'
    WHEN regexp_matches(token, {lit(html.PARAGRAPH)}) THEN 'open' WHEN regexp_matches(token, {lit(html.PARAGRAPH_END)}) THEN 'close'
    ELSE 'apart' END AS kind FROM tokens),
placed AS MATERIALIZED (
  SELECT *, count(*) FILTER (kind = 'open') OVER w AS paragraph, count(*) FILTER (kind IN ('open', 'close')) OVER w AS part,
    count(*) FILTER (kind <> 'text') OVER w AS node FROM kinds
  WINDOW w AS (PARTITION BY page_id ORDER BY nth)),
nodes AS MATERIALIZED (
  SELECT page_id, node, any_value(paragraph) AS paragraph, any_value(part) AS part,
    string_agg(translate(token, chr(1) || chr(2) || chr(3), ''), '' ORDER BY nth) AS token
  FROM placed WHERE kind = 'text' GROUP BY page_id, node),
inside AS (SELECT page_id, nth, part, paragraph FROM placed WHERE kind = 'open'),
shown AS MATERIALIZED (
  SELECT page_id, node, part, trim({decoded}, {edges}) AS t
  FROM (SELECT *, MAP {{{names}}} AS entities, MAP {{{windows}}} AS windows FROM nodes)),
paragraphs AS (
  SELECT page_id, part, string_agg(t, ' ' ORDER BY node) AS t FROM shown SEMI JOIN inside USING (page_id, part)
  WHERE t <> '' GROUP BY page_id, part),
joined AS (SELECT page_id, string_agg(t, chr(10) ORDER BY part) AS t FROM paragraphs WHERE length(t) > 20 GROUP BY page_id),
whole AS (SELECT page_id, string_agg(t, ' ' ORDER BY node) AS t FROM shown WHERE t <> '' GROUP BY page_id),
texts AS (
  SELECT p.page_id, p.url, CASE WHEN p.html IS NOT NULL THEN coalesce(j.t, w.t, '') END AS content
  FROM pages p LEFT JOIN joined j USING (page_id) LEFT JOIN whole w USING (page_id))"""


TITLE = """array_to_string(list_transform(
  regexp_extract_all(lower(replace(string_split(url, '/')[-1], '-', ' ')), '\\p{L}+|[^\\p{L}]+'),
  lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')"""


def with_(block: str, select: str) -> str:
    return f"WITH {block}\n{select}"


DEDUPED_CORPUS = """deduped AS (SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS nth FROM articles) WHERE nth = 1),
corpus AS MATERIALIZED (
  SELECT * FROM deduped WHERE coalesce(content_len, 0) >= 100 AND content IS NOT NULL)"""
#: A stored run: phrases and vocabulary learned on the selected corpus, applied to all articles; gate status of each.
RUN = DOCS + ",\n" + DEDUPED_CORPUS + """,
learned AS MATERIALIZED (SELECT * FROM flat WHERE doc_id IN (SELECT article_id FROM corpus)),
""" + counted("bi_", "learned") + ",\n" + merged("m1_", "flat", "bi_phrases", "flat_bi") + """,
learned_bi AS MATERIALIZED (SELECT * FROM flat_bi WHERE doc_id IN (SELECT article_id FROM corpus)),
""" + counted("tri_", "learned_bi", outer=True) + ",\n" + merged("m2_", "flat_bi", "tri_phrases", "flat_tri") + """,
run_vocab AS MATERIALIZED (
  SELECT term FROM flat_tri WHERE doc_id IN (SELECT article_id FROM corpus) GROUP BY term
  HAVING count(DISTINCT doc_id) >= 12 AND count(DISTINCT doc_id) <= floor(0.5 * (SELECT count(*) FROM corpus))),
known AS MATERIALIZED (SELECT DISTINCT doc_id FROM flat_tri WHERE term IN (SELECT term FROM run_vocab)),
gated AS MATERIALIZED (
  SELECT d.doc_id, a.url, k.doc_id IS NOT NULL AS known, CASE WHEN len(d.tokens) < 30 THEN 'too_few_tokens'
    WHEN k.doc_id IS NULL THEN 'no_vocabulary' WHEN coalesce(length(a.content), 0) < 100 THEN 'short_text' ELSE 'ok' END AS status
  FROM docs d JOIN articles a ON a.article_id = d.doc_id LEFT JOIN known k ON k.doc_id = d.doc_id)"""
