"""DuckDB SQL with the same rows as the queries, and the constants both share."""

from __future__ import annotations

STOP = ("that", "this", "with", "from", "have", "been", "were", "which", "their", "there")
#: Keeps 43 terms and 216 ordered pairs of the documents of sf0.01, in two components with triangles.
CUT_KEEP = 90
ROUNDS = 10
#: Queries that start from one node take the first by name of so many of greatest degree.
SEED_RANK = 3
GLOSSARY = "=:apple:= A goat explores. xyz apple crater. Explore apple explore.=:goat:= nothing here.=:explore:= The crater sphere\nterm.=:crater sphere:= nothing."
#: Word forms and stems from the published description of the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid",
    "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson",
    "consort": "consort", "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir", "constable": "constabl",
    "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant", "knack": "knack", "knackeries": "knackeri",
    "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee",
    "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit",
    "knitted": "knit", "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker",
    "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
}
WORD = r"[\p{L}\p{N}_.<=]+"
_stop = ", ".join(f"'{s}'" for s in STOP)

SPLIT = r"""
split_docs AS MATERIALIZED (
  SELECT doc_id, string_split(replace(regexp_replace(regexp_replace({text}, '\.([\p{{L}}\p{{N}}_])', chr(2) || '\1', 'g'), '[.?!]', chr(1), 'g'), chr(2), '.'), chr(1)) AS parts
  FROM {source} WHERE {text} IS NOT NULL),
raw_sents AS (
  SELECT doc_id, unnest(range(len(parts))) AS sent_ix, unnest(parts) AS part, len(parts) AS k FROM split_docs),
sents AS MATERIALIZED (
  SELECT doc_id, sent_ix, regexp_extract_all(part, '[\p{{L}}\p{{N}}_.<=]+') AS words, k FROM raw_sents
  WHERE sent_ix < k - 1 OR len(regexp_extract_all(part, '[\p{{L}}\p{{N}}_.<=]+')) > 0)
"""
DOC_SENTS = SPLIT.format(text="text", source="documents")
LOWERED = """
low AS MATERIALIZED (SELECT doc_id, sent_ix, unnest(range(len(words))) AS pos, lower(unnest(words)) AS token, unnest(words) AS surface FROM sents)
"""
VOCAB = f"""
fit AS (SELECT doc_id, token FROM low WHERE length(token) >= 4 AND NOT regexp_matches(token, '[.<=]') AND token NOT IN ({_stop})),
top_words AS MATERIALIZED (SELECT token AS term, count(DISTINCT doc_id) AS df FROM fit GROUP BY 1 ORDER BY df DESC, term LIMIT 60),
next_low AS MATERIALIZED (SELECT *, lead(token) OVER w AS token2, lead(surface) OVER w AS surface2 FROM low WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY pos)),
top_pairs AS MATERIALIZED (
  SELECT token || ' ' || token2 AS term, count(DISTINCT doc_id) AS df FROM next_low
  WHERE token IN (SELECT term FROM top_words) AND token2 IN (SELECT term FROM top_words) GROUP BY 1 ORDER BY df DESC, term LIMIT 20),
vocab AS MATERIALIZED (SELECT term, 1 AS n, df FROM top_words UNION ALL SELECT term, 2, df FROM top_pairs)
"""
MATCH = """
cand AS (
  SELECT m.doc_id, m.sent_ix AS win_ix, m.pos AS start, v.n, v.term, CASE WHEN v.n = 2 THEN m.surface || ' ' || m.surface2 ELSE m.surface END AS surface
  FROM {low} m JOIN vocab v ON (v.n = 1 AND v.term = m.token) OR (v.n = 2 AND v.term = m.token || ' ' || m.token2)),
longest AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, win_ix, start ORDER BY n DESC) = 1),
linked AS MATERIALIZED (
  SELECT *, row_number() OVER w AS r, CASE WHEN lead(start, 1) OVER w >= start + n THEN lead(start, 1) OVER w ELSE lead(start, 2) OVER w END AS nxt
  FROM longest WINDOW w AS (PARTITION BY doc_id, win_ix ORDER BY start)),
hit AS (
  SELECT doc_id, win_ix, start, nxt FROM linked WHERE r = 1
  UNION ALL
  SELECT l.doc_id, l.win_ix, l.start, l.nxt FROM hit h JOIN linked l ON l.doc_id = h.doc_id AND l.win_ix = h.win_ix AND l.start = h.nxt),
found AS MATERIALIZED (SELECT l.doc_id, l.win_ix, l.start, l.n, l.term, l.surface FROM linked l JOIN hit USING (doc_id, win_ix, start))
"""
PAIRS = """
terms AS (SELECT DISTINCT doc_id, win_ix, term FROM {found}),
pairs AS MATERIALIZED (SELECT a.doc_id, a.win_ix, a.term AS src, b.term AS dst FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND a.win_ix = b.win_ix AND a.term <> b.term),
counted AS MATERIALIZED (SELECT src, dst, count(*) AS cnt FROM pairs GROUP BY 1, 2)
"""
KEPT = f"""
cut AS (SELECT greatest(CAST(trunc(max(cnt) * CAST({(100.0 - CUT_KEEP) / 100.0!r} AS DOUBLE)) AS BIGINT), 1) AS cutoff FROM counted),
kept AS MATERIALIZED (SELECT src, dst, cnt FROM counted, cut WHERE cnt >= cutoff)
"""
GRAPH = """
arcs AS MATERIALIZED (SELECT src, dst FROM kept UNION SELECT dst, src FROM kept),
nodes AS MATERIALIZED (SELECT DISTINCT src AS term FROM arcs),
deg AS MATERIALIZED (SELECT src AS term, count(*) AS degree FROM arcs GROUP BY 1),
seed AS MATERIALIZED (SELECT min(term) AS term, max(term) AS other FROM (SELECT term FROM deg ORDER BY degree DESC, term LIMIT 3))
"""
CC = """
closed AS (SELECT a.src AS term, count(*) AS c FROM arcs a JOIN arcs b ON a.src = b.src AND a.dst < b.dst JOIN arcs t ON t.src = a.dst AND t.dst = b.dst GROUP BY 1),
cc AS MATERIALIZED (SELECT d.term, CASE WHEN degree > 1 THEN coalesce(c, 0) / (degree * (degree - 1) / 2.0) ELSE 0.0 END AS cc FROM deg d LEFT JOIN closed USING (term)),
scc AS MATERIALIZED (SELECT term, CASE WHEN sum(cc) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE cc / sum(cc) OVER () END AS value FROM cc)
"""
REACH = """
reach AS (
  SELECT term AS src, term AS dst, 0 AS dist FROM nodes
  UNION
  SELECT r.src, a.dst, r.dist + 1 FROM reach r JOIN arcs a ON a.src = r.dst WHERE r.dist < 12),
dists AS MATERIALIZED (SELECT src, dst, min(dist) AS dist FROM reach GROUP BY 1, 2),
ecc AS MATERIALIZED (SELECT src AS term, max(dist) AS ecc FROM dists GROUP BY 1)
"""


def rounds(factor: str = "", partition: str = "") -> str:
    """PageRank rounds, one CTE each; ``factor`` is the bias of n.term, ``partition`` the column of seeds."""
    seeds = "(SELECT term AS seed FROM nodes)" if partition else "(SELECT 0 AS seed)"
    out = [f"pr0 AS (SELECT seed, term, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes, {seeds})"]
    raw = "0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(got, 0)" + (f" * {factor}" if factor else "")
    for k in range(1, ROUNDS + 1):
        step = f"SELECT n.seed, n.term, {raw} AS rank FROM pr0 n LEFT JOIN (SELECT p.seed, a.dst AS term, sum(p.rank / d.degree) AS got FROM arcs a JOIN pr{k - 1} p ON p.term = a.src JOIN deg d ON d.term = a.src GROUP BY 1, 2) g ON g.seed = n.seed AND g.term = n.term"
        out.append(f"pr{k} AS MATERIALIZED (" + (f"SELECT seed, term, rank / sum(rank) OVER (PARTITION BY seed) AS rank FROM ({step})" if factor else step) + ")")
    return ",\n".join(out)


def biased(bias: float, *terms: str) -> str:
    """The factor of the nodes that a bias is on."""
    return f"CASE WHEN n.term IN ({', '.join(terms)}) THEN {1 + bias} ELSE 1.0 END"


SEED, OTHER = "(SELECT term FROM seed)", "(SELECT other FROM seed)"
INVERSE = "SELECT term, round((2 * max(rank) OVER () - rank) / (2 * max(rank) OVER () * count(*) OVER () - sum(rank) OVER ()), 6) AS value FROM {pr}"
HOOD = "hood AS (SELECT term, 0 AS dist FROM seed UNION SELECT a.dst, h.dist + 1 FROM hood h JOIN arcs a ON a.src = h.term JOIN cc u ON u.term = a.src JOIN cc v ON v.term = a.dst WHERE h.dist + 1 <= 1 OR (h.dist + 1 <= 3 AND v.cc * 0.5 >= u.cc))"
MASK = """
focus AS MATERIALIZED (
  SELECT term, (r / sum(r) OVER ()) AS rank FROM (SELECT term, 1.0 / (SELECT count(*) FROM nodes) + value AS r FROM scc)),
masked AS MATERIALIZED (
  SELECT f.term, (f.rank
    + (SELECT p.rank * p.rank FROM focus p WHERE p.term = (SELECT term FROM seed)) * coalesce((SELECT ecc FROM ecc WHERE term = (SELECT term FROM seed)) - da.dist, 0)
    + (SELECT p.rank * p.rank FROM focus p WHERE p.term = (SELECT other FROM seed)) * pow(2.0, coalesce(db.dist, (SELECT ecc FROM ecc WHERE term = (SELECT other FROM seed))))
    ) / 3.0 AS rank
  FROM focus f LEFT JOIN dists da ON da.src = (SELECT term FROM seed) AND da.dst = f.term LEFT JOIN dists db ON db.src = (SELECT other FROM seed) AND db.dst = f.term),
tops AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY round(rank, 9) DESC, term) AS place FROM masked QUALIFY place <= 10)
"""
SENT = """
texts AS MATERIALIZED (SELECT DISTINCT p.src, p.dst, array_to_string(s.words, ' ') AS sentence FROM pairs p JOIN kept USING (src, dst) JOIN sents s ON s.doc_id = p.doc_id AND s.sent_ix = p.win_ix),
tc AS (SELECT src, dst, count(*) AS c FROM texts GROUP BY 1, 2),
lc AS MATERIALIZED (
  SELECT a.src, a.dst, coalesce(x.c, 0) + coalesce(y.c, 0) AS cnt FROM arcs a LEFT JOIN tc x ON x.src = a.src AND x.dst = a.dst LEFT JOIN tc y ON y.src = a.dst AND y.dst = a.src WHERE a.src < a.dst)
"""


def query(body: str, *parts: str, source: str = DOC_SENTS) -> str:
    """Put CTEs before a body."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in (source, *parts)) + "\n" + body


_found = (LOWERED, VOCAB, MATCH.format(low="next_low"))
_pairs = (*_found, PAIRS.format(found="found"))
_graph = (*_pairs, KEPT, GRAPH)
_mask = (*_graph, CC, REACH, MASK)
_infl = "infl AS (SELECT term, surface, count(*) AS cnt, min(o) AS o FROM (SELECT term, term AS surface, (-1, -1, -1) AS o FROM vocab UNION ALL SELECT term, surface, (doc_id, win_ix, start) FROM found) GROUP BY 1, 2)"


def side(name: str, where: str) -> tuple[str, ...]:
    """Counts, cutoff and arcs of the documents that a condition takes."""
    suffix = PAIRS.format(found=f"(SELECT f.* FROM found f JOIN documents USING (doc_id) WHERE {where})") + "," + KEPT.strip() + ", arcs AS MATERIALIZED (SELECT src, dst FROM kept UNION SELECT dst, src FROM kept)"
    for word in ("terms", "pairs", "counted", "cut", "kept", "arcs"):
        suffix = _rename(suffix, word, f"{word}_{name}")
    return (suffix,)


def _rename(sql: str, word: str, to: str) -> str:
    import re

    return re.sub(rf"\b{word}\b", to, sql)


_sides = (*_found, *side("l", "coalesce(lang = 'en', false)"), *side("r", "NOT coalesce(lang = 'en', false)"))
_windows = "SELECT doc_id, w AS win_ix, array_to_string(flatten(list_slice(s, w + 1, w + 2)), ' ') AS words FROM (SELECT doc_id, s, unnest(range({last})) AS w FROM (SELECT doc_id, list(words ORDER BY sent_ix) AS s FROM sents GROUP BY 1))"
_basket = "WITH RECURSIVE terms AS (SELECT DISTINCT l_orderkey AS k, p_type AS term FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), counted AS MATERIALIZED (SELECT a.term AS src, b.term AS dst, count(*) AS cnt FROM terms a JOIN terms b ON a.k = b.k AND a.term <> b.term GROUP BY 1, 2)"
_glossary = f"""
entries AS (SELECT unnest(range(len(e))) AS doc_id, unnest(e) AS entry FROM (SELECT string_split('{GLOSSARY}', '=:')[2:] AS e)),
gloss AS MATERIALIZED (SELECT doc_id, trim(string_split(entry, ':=')[1]) AS head, trim(string_split(entry, ':=')[2]) AS text FROM entries)
"""
_gloss_vocab = "vocab AS MATERIALIZED (SELECT DISTINCT head AS term, len(string_split(head, ' ')) AS n FROM gloss), next_low AS (SELECT *, lead(token) OVER w AS token2, lead(surface) OVER w AS surface2 FROM low WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY pos))"
_conv = "turns AS MATERIALIZED (SELECT conv_id AS doc_id, turn AS sent_ix, unnest(range(len(w))) AS pos, lower(unnest(w)) AS token, unnest(w) AS surface FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_.<=]+') AS w FROM conversations)), next_turn AS (SELECT *, lead(token) OVER w AS token2, lead(surface) OVER w AS surface2 FROM turns WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY pos))"

_bodies = r"""
bodies AS MATERIALIZED (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 'gs'), '<[^>]*>', ' ', 'g'), '\n', chr(10) || chr(10), 'g') AS text, list_distinct(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS links, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 'gs'), '<[^>]*>', ' ', 'g') AS body FROM pages)
"""
_link_vocab = r"""
named AS (SELECT lower(array_to_string(regexp_extract_all(link, '[\p{L}\p{N}_.<=]+'), ' ')) AS term FROM (SELECT body, unnest(links) AS link FROM bodies) WHERE link <> '' AND contains(body, link)),
vocab AS MATERIALIZED (SELECT DISTINCT term, len(string_split(term, ' ')) AS n FROM named WHERE term NOT IN ('', '1')),
next_low AS (SELECT *, lead(token) OVER w AS token2, lead(surface) OVER w AS surface2 FROM low WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY pos))
"""

ORACLE_SQL = {
    "sentence_split": query("SELECT doc_id, sent_ix, array_to_string(words, ' ') AS words FROM sents"),
    "sentence_stats": query("SELECT doc_id, count(*) AS sentences, CAST(sum(len(words)) AS BIGINT) AS words, count(*) FILTER (len(words) = 0) AS empty FROM sents GROUP BY 1"),
    "token_frequency": query("SELECT token, count(*) AS cnt FROM low GROUP BY 1", LOWERED),
    "vocab_top_terms": query("SELECT term, CAST(n AS BIGINT) AS n, df FROM vocab", LOWERED, VOCAB),
    "term_matches": query("SELECT doc_id, win_ix, start, term, surface FROM found", *_found),
    "inflection_counts": query("SELECT term, surface, cnt FROM infl", *_found, _infl),
    "dominant_inflection": query("SELECT term, surface, cnt FROM infl QUALIFY row_number() OVER (PARTITION BY term ORDER BY cnt DESC, o, surface) = 1", *_found, _infl),
    "windows_ref_w2": query(_windows.format(last="CAST(ceil(len(s) / 2.0) AS BIGINT)")),
    "windows_sliding_w2": query(_windows.format(last="greatest(len(s) - 1, 1)")),
    "cooc_pairs": query("SELECT doc_id, win_ix, src, dst FROM pairs", *_pairs),
    "cooc_counts": query("SELECT src, dst, cnt FROM counted", *_pairs),
    "cooc_histogram": query("SELECT cnt, count(*) AS pairs FROM counted GROUP BY 1", *_pairs),
    "cooc_stats": query("SELECT max(cnt) AS max_cnt, min(cnt) AS min_cnt, round(avg(cnt), 6) AS avg_cnt FROM counted", *_pairs),
    "cooc_cutoff": query("SELECT src, dst, cnt FROM kept", *_pairs, KEPT),
    "pair_sentences": query("SELECT src, dst, sentence FROM texts", *_graph, SENT),
    "included_excluded": query("SELECT DISTINCT term, true AS included FROM (SELECT src AS term FROM kept UNION SELECT dst FROM kept) UNION ALL SELECT DISTINCT src, false FROM counted WHERE src NOT IN (SELECT src FROM kept)", *_pairs, KEPT),
    "glossary_cooc": query("SELECT g.head AS src, f.term AS dst, count(*) AS cnt FROM (SELECT DISTINCT doc_id, win_ix, term FROM found) f JOIN gloss g USING (doc_id) WHERE f.term <> g.head GROUP BY 1, 2", SPLIT.format(text="text", source="gloss"), LOWERED, _gloss_vocab, MATCH.format(low="next_low"), source=_glossary),
    "articles_links_vocab": r"""WITH p AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1))) AS link, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 'gs'), '<[^>]*>', ' ', 'g') AS body FROM pages)
SELECT DISTINCT lower(array_to_string(regexp_extract_all(link, '[\p{L}\p{N}_.<=]+'), ' ')) AS term FROM p WHERE link <> '' AND contains(body, link) AND array_to_string(regexp_extract_all(link, '[\p{L}\p{N}_.<=]+'), ' ') NOT IN ('', '1')""",
    "graph_edges": query("SELECT src, dst FROM arcs WHERE src < dst", *_graph),
    "degree": query("SELECT term, degree FROM deg", *_graph),
    "sub_graph": query("SELECT src, dst FROM arcs WHERE src < dst AND src IN (SELECT term FROM t10) AND dst IN (SELECT term FROM t10)", *_graph, "t10 AS (SELECT term FROM deg ORDER BY degree DESC, term LIMIT 10)"),
    "adjacency_long": query("SELECT src AS row, dst AS col, CAST(1 AS BIGINT) AS value FROM arcs UNION ALL SELECT term, term, 1 FROM nodes", *_graph),
    "clustering_coefficient": query("SELECT term, round(cc, 6) AS cc FROM cc", *_graph, CC),
    "clustering_coefficient_directed": query("SELECT n.term, round(CASE WHEN coalesce(k, 0) > 1 THEN coalesce(c, 0) / (k * (k - 1.0)) ELSE 0.0 END, 6) AS cc FROM nodes n LEFT JOIN (SELECT src AS term, count(*) AS k FROM d GROUP BY 1) USING (term) LEFT JOIN (SELECT a.src AS term, count(*) AS c FROM d a JOIN d b ON a.src = b.src JOIN d t ON t.src = a.dst AND t.dst = b.dst GROUP BY 1) USING (term)", *_graph, "d AS MATERIALIZED (SELECT src, dst FROM arcs WHERE src < dst)"),
    "neighbourhood_1": query("SELECT term, CAST(0 AS BIGINT) AS dist FROM seed UNION ALL SELECT dst, 1 FROM arcs WHERE src = (SELECT term FROM seed)", *_graph),
    "neighbourhood_expanded": query("SELECT term, CAST(min(dist) AS BIGINT) AS dist FROM hood GROUP BY 1", *_graph, CC, HOOD),
    "distances": query("SELECT a.term AS src, b.term AS dst, CAST(d.dist AS DOUBLE) AS dist FROM nodes a CROSS JOIN nodes b LEFT JOIN dists d ON d.src = a.term AND d.dst = b.term", *_graph, REACH),
    "eccentricity": query("SELECT term, CAST(ecc AS BIGINT) AS ecc FROM ecc", *_graph, REACH),
    "diameter": query("SELECT CAST(max(ecc) AS BIGINT) AS diameter FROM ecc", *_graph, REACH),
    "pagerank_k": query(f"SELECT term, round(rank, 6) AS rank FROM pr{ROUNDS}", *_graph, rounds()),
    "biased_pagerank_k": query(f"SELECT term, round(rank, 6) AS rank FROM pr{ROUNDS}", *_graph, rounds(biased(0.5, SEED))),
    "inverse_pagerank_k": query(INVERSE.format(pr=f"pr{ROUNDS}"), *_graph, rounds()),
    "scaled_cc": query("SELECT term, round(value, 6) AS value FROM scc", *_graph, CC),
    "inverse_cc": query("SELECT term, round((2 * max(value) OVER () - value) / (2 * max(value) OVER () * count(*) OVER () - sum(value) OVER ()), 6) AS value FROM scc", *_graph, CC),
    "fitted_cc": query("SELECT term, round(value * 0.5 / max(value) OVER (), 6) AS value FROM scc", *_graph, CC),
    "session_focus": query("SELECT 'left' AS grp, term, round(rank, 6) AS rank FROM focus", *_mask),
    "masked_rank": query("SELECT 'left' AS grp, term, round(rank, 6) AS rank FROM masked", *_mask),
    "top_k_per_group": query("SELECT 'left' AS grp, term, place FROM tops", *_mask),
    "display_nodes": query("SELECT m.term AS name, round(m.rank, 6) AS rank, CASE WHEN t.term IS NULL THEN 0.1 ELSE 1.0 END AS alpha, 'left' AS groups FROM masked m LEFT JOIN tops t USING (term)", *_mask),
    "display_links": query("SELECT l.src AS source, l.dst AS target, CASE WHEN l.src IN (SELECT term FROM tops) AND l.dst IN (SELECT term FROM tops) THEN 1.0 ELSE 0.1 END AS alpha, round(CAST(cnt AS DOUBLE) / max(cnt) OVER () * 280.0, 6) AS distance, 'full' AS stroke FROM lc l", *_mask, SENT),
    "link_distance": query("SELECT src, dst, cnt, round(CAST(cnt AS DOUBLE) / max(cnt) OVER () * 280.0, 6) AS distance FROM lc", *_graph, SENT),
    "best_link_summary": query("SELECT b.src, b.dst, round(b.score, 6) AS score, md5((SELECT string_agg(sentence, '|||' ORDER BY sentence) FROM texts t WHERE (t.src = b.src AND t.dst = b.dst) OR (t.src = b.dst AND t.dst = b.src))) AS summary FROM (SELECT l.src, l.dst, a.rank + c.rank AS score FROM lc l JOIN masked a ON a.term = l.src JOIN masked c ON c.term = l.dst WHERE l.src IN (SELECT term FROM tops) AND l.dst IN (SELECT term FROM tops) ORDER BY round(score, 9) DESC, l.src, l.dst LIMIT 1) b", *_mask, SENT),
    "compare_union": query("SELECT src, dst FROM (SELECT * FROM arcs_l UNION SELECT * FROM arcs_r) WHERE src < dst", *_sides),
    "compare_groups": query("SELECT term, string_agg(g, ',' ORDER BY g) AS groups FROM (SELECT DISTINCT src AS term, 'left' AS g FROM arcs_l UNION ALL SELECT DISTINCT src, 'right' FROM arcs_r) GROUP BY 1", *_sides),
    "compare_properties": query("SELECT least(coalesce(a.lo, 0), coalesce(b.lo, 0)) AS min_cnt, greatest(coalesce(a.hi, 0), coalesce(b.hi, 0)) AS max_cnt, CASE WHEN x.cutoff = y.cutoff THEN x.cutoff END AS cutoff, (SELECT count(DISTINCT src) FROM (SELECT src FROM arcs_l UNION SELECT src FROM arcs_r)) AS total_terms, round((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2, 6) AS avg_cnt FROM (SELECT min(cnt) AS lo, max(cnt) AS hi, avg(cnt) AS m FROM counted_l) a, (SELECT min(cnt) AS lo, max(cnt) AS hi, avg(cnt) AS m FROM counted_r) b, cut_l x, cut_r y", *_sides),
    "stem_samples": "SELECT word, stem FROM (VALUES " + ", ".join(f"('{w}', '{t}')" for w, t in STEMS.items()) + ") AS v(word, stem)",
    "lemma_counts": query("SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM infl GROUP BY 1", *_found, _infl),
    "merged_inflections": query("SELECT term, surface, cnt + CASE WHEN surface = term THEN 1 ELSE 0 END AS cnt FROM infl", *_found, _infl),
    "decoded_names": query("SELECT DISTINCT name, coalesce(e.term, l.term) AS term FROM (SELECT surface AS name FROM infl UNION SELECT upper(surface) FROM infl) LEFT JOIN infl e ON e.surface = name LEFT JOIN infl l ON l.surface = lower(name)", *_found, _infl),
    "built_glossary": query("SELECT DISTINCT least(g.head, f.term) AS src, greatest(g.head, f.term) AS dst FROM found f JOIN gloss g USING (doc_id) WHERE f.term <> g.head", SPLIT.format(text="text", source="gloss"), LOWERED, _gloss_vocab, MATCH.format(low="next_low"), source=_glossary),
    "built_articles": query("SELECT src, dst, cnt FROM counted", SPLIT.format(text="text", source="bodies"), LOWERED, _link_vocab, MATCH.format(low="next_low"), PAIRS.format(found="found"), source=_bodies),
    "biased_metric": query(f"SELECT term, round(rank, 6) AS value FROM pr{ROUNDS}", *_graph, rounds(biased(0.1, SEED, OTHER))),
    "inverse_biased_metric": query(INVERSE.format(pr=f"pr{ROUNDS}"), *_graph, rounds(biased(0.1, SEED))),
    "all_seed_pagerank": query(f"SELECT seed, term, round(rank, 6) AS rank FROM pr{ROUNDS}", *_graph, rounds(biased(0.1, "n.seed"), "seed")),
    "log_size": query("SELECT round(log10(count(*) + 1), 6) AS log_size FROM nodes", *_graph),
    "session_search": query("SELECT m.term AS name, round(m.rank, 6) AS rank, CASE WHEN row_number() OVER (ORDER BY round(m.rank, 9) DESC, m.term) <= 10 THEN 1.0 ELSE 0.1 END AS alpha FROM masked m WHERE m.term IN (SELECT term FROM hood)", *_mask, HOOD),
    "session_highlight": query("SELECT term AS name, CASE WHEN selected THEN 1.0 WHEN term IN (SELECT dst FROM arcs WHERE src = (SELECT term FROM lit)) THEN 0.55 ELSE 0.1 END AS alpha FROM shown WHERE selected OR term <> (SELECT term FROM mid)", *_mask,
        "mid AS (SELECT term FROM (SELECT term FROM deg ORDER BY degree DESC, term LIMIT 3) WHERE term NOT IN (SELECT term FROM seed UNION ALL SELECT other FROM seed))", "lit AS (SELECT min(term) AS term FROM nodes)",
        "best AS (SELECT term FROM masked WHERE term <> (SELECT term FROM mid) ORDER BY round(rank, 9) DESC, term LIMIT 10)", "shown AS (SELECT term, term IN (SELECT term FROM best) OR term = (SELECT term FROM lit) AS selected FROM masked)"),
    "session_totals": query("SELECT md5(coalesce((SELECT string_agg(sentence, '|||' ORDER BY sentence) FROM texts t WHERE (t.src = b.src AND t.dst = b.dst) OR (t.src = b.dst AND t.dst = b.src)), '')) AS summary, (SELECT count(*) FROM nodes) AS size, (SELECT count(*) FROM tops) AS selection FROM (SELECT l.src, l.dst FROM lc l JOIN masked a ON a.term = l.src JOIN masked c ON c.term = l.dst WHERE l.src IN (SELECT term FROM tops) AND l.dst IN (SELECT term FROM tops) ORDER BY round(a.rank + c.rank, 9) DESC, l.src, l.dst LIMIT 1) b", *_mask, SENT),
    "session_chart": query("SELECT term AS name, round(rank, 6) AS rank FROM masked ORDER BY round(rank, 9) DESC, term LIMIT 35", *_mask),
    "session_radii": query("SELECT term AS name, round(least(greatest(rank * 1000.0, 5.0), 50.0), 6) AS radius FROM masked", *_mask),
    "basket_cooc_part_type": _basket + " SELECT src, dst, cnt FROM counted",
    "basket_pagerank": _basket + ", " + KEPT.strip() + "," + GRAPH.strip() + "," + rounds() + f" SELECT term, round(rank, 6) AS rank FROM pr{ROUNDS}",
    "conversation_cooc": query("SELECT src, dst, cnt FROM counted", LOWERED, VOCAB, _conv, MATCH.format(low="next_turn"), PAIRS.format(found="found")),
}
