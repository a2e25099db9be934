"""SQL that gives the results of plans.enrichment over the same tables."""

from __future__ import annotations

from termweave.functions import text as X
from termweave.plans.hierarchies import GRAPH

# Written here a second time, so that a wrong list or pattern of the queries shows.
ID = r"\bVX[12345CM]G[0-9]{9}\b"
EVIDENCE = r"(?i)\{ECO:[^}]*\}|\(PubMed[^)]*\)|\(By similarity[^)]*\)|PubMed:[0-9]+"
ENZYME = r"\bEC\s?[0-9]+((\.[-0-9]+)?(\.[-0-9]+)?(\.[-0-9]+)?)\b"
PREFIXED = r"\b(anti|cis|co|cross|extra|hetero|homo|inter|intra|mono|multi|non|poly|post|pre|pro|self|semi|short|sub|trans)-([a-z])"
KEPT_WHOLE = """abscisic analysis apoptosis axis basis biosynthesis bus cactus chitosanase class embryogenesis focus gas genesis glass has his homeostasis
hydrolysis is its lens lysis meiosis mitosis morphogenesis mucus nucleus organogenesis osmosis pathogenesis pius plus process senescence series species
status stress synthesis thesis this thus trans tris virus was""".split()
TECHNICAL = ("3D-structure", "Acetylation", "Alternative splicing", "Direct protein sequencing", "Phosphoprotein", "Proteomics identification", "Reference proteome", "Signal")
ROOTS = ("GO:0003674", "GO:0005575", "GO:0008150")
NOISE = "best blast blink contains encodes expressed functions has hits interpro involved match ncbi plant plants protein proteincoding proteins source".split()


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lemma(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 4 OR {w} IN {listed(KEPT_WHOLE)} OR regexp_matches({w}, '(sis|ss|us|ics)$') THEN {w}
 WHEN {w} LIKE '%ies' AND length({w}) > 5 THEN {w}[:-4] || 'y' WHEN regexp_matches({w}, '(ches|shes|xes|zes)$') THEN {w}[:-3]
 WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(is|as)$') THEN {w}[:-2] ELSE {w} END"""


def stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{e}' AND length({w}) - {len(e)} >= 4 THEN {w}[:-{len(e) + 1}]" for e in ("ers", "er", "ions", "ion", "ing", "ed"))
    return f"CASE {cases} ELSE {w} END"


def cleaned(t: str) -> str:
    out = f"regexp_replace(replace({t}, 'FUNCTION: ', ' '), '\\s*\\{{ECO:[^}}]*\\}}', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)\\s*\\((PubMed|By similarity|Ref\\.)[^)]*\\)', '', 'g'), '\\.(\\s*\\.)+', '.', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


def token_list(t: str, stop: list[str]) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({t}, '{EVIDENCE}', ' ', 'g'), '{ENZYME}', ' ', 'g'), '(?i){ID}', ' ', 'g')"
    out = f"regexp_replace(lower({out}), '{PREFIXED}', '\\1\u2011\\2', 'g')"
    out = f"regexp_replace(translate({out}, '-/', '  '), '[][.,;:(){{}}\"]+', ' . ', 'g')"
    token = "^[a-z]([a-z0-9''\u2011]*[a-z0-9])?$"
    valid = f"regexp_matches(w, '{token}') AND length(w) >= 3 AND w NOT IN {listed(stop)} AND NOT regexp_matches(w, '[0-9]')"
    return f"list_transform(list_transform(regexp_split_to_array(trim({out}, ' '), '\\s+'), lambda r: trim(r, '''')), lambda w: CASE WHEN {valid} THEN {lemma('w')} END)"


def present(x: str) -> str:
    return f"CASE WHEN trim({x}, ' ') NOT IN ('', '-') THEN trim({x}, ' ') END"


def parts(field: str, values: str) -> str:
    return f"SELECT entity_id, row_no, reviewed, '{field}' AS field, unnest({values}) AS value, generate_subscripts({values}, 1) AS pos FROM source_"


def present_list(c: str) -> str:
    return f"list_transform(coalesce({c}, []), lambda x: {present('x')})"


FIELDS = {
    "id": "['']", "symbol": f"[{present('symbol')}]", "description": f"[{present('description')}]", "function": f"[nullif({cleaned('function_text')}, '')]",
    "synonyms": present_list("synonyms"), "names": present_list("full_names"), "protein_names": present_list("protein_names"), "keywords": present_list("keywords"), "families": present_list("families"),
    "go": f"list_transform({present_list('go_ids')}, lambda x: upper(x))",
}
REVIEWED = listed(("protein_names", "function", "keywords", "families"))
TAIL = """CASE WHEN k_study <= greatest(0, n_study + k_bg - n_bg) THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k_study, least(n_study, k_bg) + 1), lambda x: exp(
 lgamma(k_bg + 1) - lgamma(x + 1) - lgamma(k_bg - x + 1) + lgamma(n_bg - k_bg + 1) - lgamma(n_study - x + 1) - lgamma(n_bg - k_bg - n_study + x + 1)
 - lgamma(n_bg + 1) + lgamma(n_study + 1) + lgamma(n_bg - n_study + 1))))) END"""


def log(x: str) -> str:
    return f"round(-log10(greatest({x}, 1e-300)), 6) + 0.0"


PRELUDE = rf"""WITH RECURSIVE {GRAPH},
source_ AS (SELECT upper(split_part(trim(id, ' '), '.', 1)) AS entity_id, * REPLACE (coalesce(reviewed, false) AS reviewed) FROM gene WHERE upper(split_part(trim(id, ' '), '.', 1)) <> ''),
everyone_ AS (SELECT DISTINCT entity_id FROM source_),
terms_ AS (SELECT upper(trim(id, ' ')) AS id, min(term_name) AS term_name, min(term_namespace) AS term_namespace, bool_or(coalesce(obsolete, false)) AS obsolete FROM ontology WHERE trim(id, ' ') <> '' GROUP BY 1),
alt_ AS (SELECT upper(trim(alt_id, ' ')) AS given, min(upper(trim(term_id, ' '))) AS id FROM alt_term WHERE trim(alt_id, ' ') <> '' AND trim(term_id, ' ') <> '' GROUP BY 1),
resolved_ AS (SELECT g.given, g.id, t.term_name FROM (SELECT id AS given, id FROM terms_ WHERE id NOT IN (SELECT given FROM alt_) UNION ALL SELECT given, id FROM alt_) g JOIN terms_ t ON t.id = g.id AND NOT t.obsolete),
names_ AS (SELECT DISTINCT id, term_name FROM resolved_),
long_ AS ({" UNION ALL ".join(parts(f, v) for f, v in FIELDS.items())}),
kept_ AS (SELECT * FROM long_ WHERE value IS NOT NULL AND field <> 'go' AND NOT (field IN ('symbol', 'synonyms') AND regexp_full_match(value, '(?i){ID}'))
 UNION ALL SELECT l.entity_id, l.row_no, l.reviewed, l.field, r.id, l.pos FROM long_ l JOIN resolved_ r ON r.given = l.value WHERE l.field = 'go'),
flags_ AS (SELECT entity_id, bool_or(reviewed) AS reviewed FROM source_ GROUP BY 1),
once_ AS (SELECT k.entity_id, field, value, min((row_no, pos)) AS first_at, max(row_no) AS last FROM kept_ k JOIN flags_ f USING (entity_id) WHERE NOT (field IN {REVIEWED} AND f.reviewed AND NOT k.reviewed) GROUP BY ALL),
lists_ AS (SELECT entity_id, field, list(value ORDER BY first_at) AS vs, list(value ORDER BY last DESC, value DESC) AS latest FROM once_ GROUP BY ALL),
records_ AS MATERIALIZED (SELECT e.entity_id AS id, coalesce(max(vs[1]) FILTER (field = 'symbol'), '') AS symbol, coalesce(max(latest[1]) FILTER (field = 'description'), '') AS description,
 coalesce(max(list_reduce(list_prepend('', vs), lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE trim(acc || ' ' || x, ' ') END)) FILTER (field = 'function'), '') AS function,
 {", ".join(f"coalesce(max(vs) FILTER (field = '{f}'), []) AS {f}" for f in ("synonyms", "names", "protein_names", "keywords", "families", "go"))}, any_value(f.reviewed) AS reviewed
 FROM everyone_ e JOIN flags_ f USING (entity_id) LEFT JOIN lists_ l USING (entity_id) GROUP BY e.entity_id),
texts_ AS (SELECT * FROM (
 SELECT id AS entity_id, 'names' AS field_name, unnest(names) AS text FROM records_ UNION ALL SELECT id, 'description', description FROM records_ UNION ALL
 SELECT id, 'protein_names', unnest(protein_names) FROM records_ UNION ALL SELECT id, 'function', function FROM records_ UNION ALL SELECT id, 'families', unnest(families) FROM records_ UNION ALL
 SELECT g.entity_id, 'go_names', coalesce(n.term_name, g.go) FROM (SELECT id AS entity_id, unnest(go) AS go FROM records_) g LEFT JOIN names_ n ON n.id = g.go) WHERE text <> ''),
tokens_ AS MATERIALIZED (SELECT entity_id, {token_list("text", X.stop_words())} AS k FROM texts_),
words_ AS MATERIALIZED (SELECT DISTINCT entity_id, word FROM (SELECT entity_id, unnest(k) AS word FROM tokens_) WHERE word IS NOT NULL),
pairs_ AS MATERIALIZED (SELECT DISTINCT entity_id, pair FROM (SELECT entity_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS pair FROM tokens_) WHERE pair IS NOT NULL),
wdf_ AS MATERIALIZED (SELECT word, count(*) AS n FROM words_ GROUP BY 1),
pdf_ AS (SELECT pair, count(*) AS n FROM pairs_ GROUP BY 1),
scored_ AS (SELECT pair, p.n AS n_pair, a.n AS n_a, b.n AS n_b, ln((p.n / m) / ((a.n / m) * (b.n / m))) / -ln(p.n / m) AS npmi
 FROM pdf_ p JOIN wdf_ a ON a.word = split_part(pair, ' ', 1) JOIN wdf_ b ON b.word = split_part(pair, ' ', 2), (SELECT count(*)::DOUBLE AS m FROM everyone_) WHERE p.n >= 5 AND a.word <> b.word AND p.n < m),
phrases_ AS MATERIALIZED (SELECT * FROM scored_ WHERE npmi >= 0.35 ORDER BY npmi DESC, split_part(pair, ' ', 1) DESC, split_part(pair, ' ', 2) DESC LIMIT 20000),
held_terms_ AS (SELECT DISTINCT entity_id, id FROM (SELECT id AS entity_id, unnest(go) AS id FROM records_ UNION ALL SELECT g.entity_id, r.ancestor_id FROM (SELECT id AS entity_id, unnest(go) AS go FROM records_) g JOIN reach_ r ON r.id = g.go) WHERE id NOT IN {listed(ROOTS)}),
word_ AS (SELECT entity_id, 'word' AS layer, 'w:' || word AS concept, word AS label FROM words_),
phrase_ AS (SELECT entity_id, 'phrase' AS layer, 'p:' || pair AS concept, pair AS label FROM pairs_ WHERE pair IN (SELECT pair FROM phrases_)),
keyword_ AS (SELECT DISTINCT entity_id, 'keyword' AS layer, 'k:' || label AS concept, label FROM (SELECT id AS entity_id, unnest(keywords) AS label FROM records_) WHERE label NOT IN {listed(TECHNICAL)}),
go_ AS (SELECT entity_id, 'GO ' || coalesce(CASE term_namespace WHEN 'biological_process' THEN 'BP' WHEN 'molecular_function' THEN 'MF' WHEN 'cellular_component' THEN 'CC' END, '') AS layer, 'g:' || t.id AS concept, coalesce(term_name, t.id) AS label FROM held_terms_ h JOIN terms_ t ON t.id = h.id),
sets_ AS (SELECT set_name AS set_id, upper(regexp_extract(entity_id, '(?i)({ID})', 1)) AS entity_id, min(pos_no) AS pos FROM gene_list
 WHERE set_name IS NOT NULL AND NOT starts_with(ltrim(entity_id), '#') AND regexp_extract(entity_id, '(?i)({ID})', 1) <> '' GROUP BY 1, 2)"""


def enriched(layers: str) -> str:
    """CTEs of the test over the union of the given layer tables."""
    return f""",
index_ AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM {layer}_" for layer in layers.split())}),
inside_ AS (SELECT DISTINCT entity_id FROM index_ SEMI JOIN everyone_ USING (entity_id)),
total_ AS (SELECT count(*) AS n_bg FROM inside_),
study_ AS (SELECT set_id, entity_id FROM sets_ SEMI JOIN inside_ USING (entity_id)),
sizes_ AS (SELECT set_id, count(*) AS n_study FROM study_ GROUP BY 1),
known_ AS (SELECT layer, concept, label, count(*) AS k_bg FROM index_ GROUP BY ALL),
hits_ AS (SELECT set_id, concept, count(*) AS k_study FROM study_ JOIN index_ USING (entity_id) GROUP BY ALL),
counts_ AS (SELECT set_id, concept, layer, label, k_study, n_study, k_bg, n_bg, (k_study / n_study) / (k_bg / n_bg) AS fold, k_study >= 2 AS tested FROM hits_ JOIN known_ USING (concept) JOIN sizes_ USING (set_id), total_ WHERE k_bg <= 0.25 * n_bg),
tails_ AS MATERIALIZED (SELECT k_study, n_study, k_bg, n_bg, {TAIL} AS p_value FROM (SELECT DISTINCT k_study, n_study, k_bg, n_bg FROM counts_)),
tests_ AS (SELECT c.*, p_value FROM counts_ c JOIN tails_ t USING (k_study, n_study, k_bg, n_bg)),
ranked_ AS (SELECT *, p_value * count(*) OVER (PARTITION BY set_id) / count(*) OVER (PARTITION BY set_id ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS raw FROM tests_ WHERE tested),
rates_ AS (SELECT * EXCLUDE (raw), least(1.0, min(raw) OVER (PARTITION BY set_id ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM ranked_ UNION ALL SELECT *, 1.0 FROM tests_ WHERE NOT tested),
results_ AS (SELECT *, CASE WHEN tested AND fold >= 1 AND fdr <= 0.05 THEN 'significant' WHEN tested AND fold >= 1 AND p_value <= 0.01 THEN 'trend' ELSE '' END AS status FROM rates_)"""


def described(layers: str) -> str:
    """CTEs from the test's results to groups, display names and lists of members; the merge walks the candidates in order."""
    return f"""{enriched(layers)},
placed_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY fdr, p_value, k_study DESC, layer, concept) AS rank FROM results_),
cand_ AS MATERIALIZED (SELECT set_id, rank, concept, label, layer, k_study AS size, list_distinct(list_transform(regexp_split_to_array(lower(label), '\\s+'), lambda w: {stem('w')})) AS stems FROM placed_ WHERE status <> ''),
carried_ AS MATERIALIZED (SELECT c.set_id, c.rank, s.entity_id FROM cand_ c JOIN index_ i USING (concept) JOIN study_ s ON s.set_id = c.set_id AND s.entity_id = i.entity_id),
shared_ AS (SELECT a.set_id, a.rank, b.rank AS earlier, count(*) AS shared FROM carried_ a JOIN carried_ b ON a.set_id = b.set_id AND a.entity_id = b.entity_id AND b.rank < a.rank GROUP BY ALL),
close_ AS MATERIALIZED (SELECT s.* FROM shared_ s JOIN cand_ a ON a.set_id = s.set_id AND a.rank = s.rank JOIN cand_ b ON b.set_id = s.set_id AND b.rank = s.earlier
 WHERE shared / (a.size + b.size - shared) >= 0.75 OR ((len(list_intersect(a.stems, b.stems)) = least(len(a.stems), len(b.stems))) AND shared / least(a.size, b.size) >= 0.5)),
before_ AS (SELECT set_id, rank, list(earlier) AS before FROM close_ GROUP BY ALL),
nodes__ AS MATERIALIZED (SELECT c.set_id, c.rank, row_number() OVER (PARTITION BY c.set_id ORDER BY c.rank) AS i, coalesce(before, CAST([] AS BIGINT[])) AS before FROM cand_ c LEFT JOIN before_ b USING (set_id, rank)),
walk_ AS (SELECT DISTINCT set_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS heads FROM cand_ UNION ALL
 SELECT w.set_id, n.i, CASE WHEN list_has_any(w.heads, n.before) THEN w.heads ELSE list_append(w.heads, n.rank) END FROM walk_ w JOIN nodes__ n ON n.set_id = w.set_id AND n.i = w.i + 1),
heads_ AS (SELECT set_id, arg_max(heads, i) AS heads FROM walk_ GROUP BY 1),
groups_ AS MATERIALIZED (SELECT n.set_id, n.rank, coalesce(list_min(list_intersect(h.heads, n.before)), n.rank) AS group_rank FROM nodes__ n JOIN heads_ h USING (set_id)),
phrases__ AS (SELECT entity_id, label AS phrase, unnest(list_distinct(string_split(label, ' '))) AS word FROM index_ WHERE layer = 'phrase'),
rare_ AS (SELECT label AS phrase, count(*) AS overall FROM index_ WHERE layer = 'phrase' GROUP BY 1),
votes_ AS (SELECT c.set_id, c.rank, c.size, p.phrase, count(*) AS votes FROM cand_ c JOIN groups_ g ON g.set_id = c.set_id AND g.rank = c.rank AND g.group_rank = c.rank
 JOIN carried_ m ON m.set_id = c.set_id AND m.rank = c.rank JOIN phrases__ p ON p.entity_id = m.entity_id AND p.word = c.label WHERE c.layer = 'word' GROUP BY ALL),
named_ AS (SELECT set_id, rank, phrase FROM votes_ JOIN rare_ USING (phrase) WHERE votes >= greatest(2, ceil(2 * size / 3)) QUALIFY row_number() OVER (PARTITION BY set_id, rank ORDER BY votes DESC, overall, phrase) = 1),
merged_ AS (SELECT g.set_id, g.group_rank AS rank, string_agg(c.label, ', ' ORDER BY c.rank) AS merged FROM groups_ g JOIN cand_ c USING (set_id, rank) JOIN cand_ h ON h.set_id = g.set_id AND h.rank = g.group_rank WHERE g.rank <> g.group_rank AND c.label <> h.label GROUP BY ALL),
lists__ AS (SELECT m.set_id, m.rank, string_agg(m.entity_id, ', ' ORDER BY m.entity_id) AS genes, string_agg(coalesce(nullif(r.symbol, ''), m.entity_id), ', ' ORDER BY m.entity_id) AS symbols FROM carried_ m LEFT JOIN records_ r ON r.id = m.entity_id GROUP BY ALL),
described_ AS (SELECT p.* EXCLUDE (label), replace(p.label, '\u2011', '-') AS label, coalesce(g.group_rank = p.rank, false) AS representative, replace(coalesce(n.phrase, p.label), '\u2011', '-') AS display,
 replace(coalesce(m.merged, ''), '\u2011', '-') AS merged, coalesce(l.genes, '') AS genes, coalesce(l.symbols, '') AS symbols
 FROM placed_ p LEFT JOIN groups_ g USING (set_id, rank) LEFT JOIN named_ n USING (set_id, rank) LEFT JOIN merged_ m USING (set_id, rank) LEFT JOIN lists__ l USING (set_id, rank)),
leads_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY rank) AS place FROM described_ WHERE status = 'significant' AND representative) WHERE place <= 8)"""


EVERY = described('word phrase keyword')
ROUNDED = f"""set_id, concept, layer, label, k_study, n_study, k_bg, n_bg, round(fold, 6) AS fold, {log('p_value')} AS p_value, tested, {log('fdr')} AS fdr, status,
 CASE WHEN status <> '' THEN row_number() OVER (PARTITION BY set_id ORDER BY results_.fdr, results_.p_value, k_study DESC, layer, concept) END AS place"""
PUNCTUATION = "[^\\w\\s\u0080-\U0010ffff]|_"
LEGACY = rf""",
corpus_ AS (SELECT entity_id, text FROM texts_ WHERE field_name <> 'go_names'),
legacy_ AS (SELECT entity_id, word, count(*) AS n FROM (SELECT entity_id, unnest(regexp_split_to_array(trim(lower(regexp_replace(text, '{PUNCTUATION}', '', 'g')), ' '), '\s+')) AS word FROM corpus_)
 WHERE length(word) >= 3 AND word NOT IN {listed(X.ENGLISH_STOP_WORDS.split())} GROUP BY ALL)"""
ORACLE = {
    "normalise_ids": "SELECT row_no, nullif(upper(split_part(trim(id, ' '), '.', 1)), '') AS gene FROM gene",
    "recognised_members": f"{PRELUDE} SELECT set_id, pos, entity_id FROM sets_",
    "set_sizes": f"{PRELUDE} SELECT set_id, count(*) AS n_ids, min(entity_id) AS first_id FROM sets_ GROUP BY 1",
    "clean_text": f"SELECT row_no, {cleaned('function_text')} AS cleaned FROM gene",
    "split_names": "SELECT row_no, coalesce(array_to_string(list_filter(list_transform(list_filter(protein_names, lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')), lambda x: NOT starts_with(x, 'EC ')), '|'), '') AS parts FROM gene",
    "lemma": f"SELECT word, {lemma('word')} AS lemma, {stem('word')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(function_text), '[a-z]+')) AS word FROM gene)",
    "merge_records": f"""{PRELUDE} SELECT id, symbol, description, function, {", ".join(f"array_to_string({f}, '|') AS {f}" for f in ("synonyms", "names", "protein_names", "keywords", "families", "go"))}, reviewed FROM records_""",
    "text_fields": f"{PRELUDE} SELECT * FROM texts_",
    "concepts_word": f"{PRELUDE} SELECT * FROM words_",
    "word_df": f"{PRELUDE} SELECT * FROM wdf_",
    "bigram_df": f"{PRELUDE} SELECT * FROM pdf_",
    "phrases_npmi": f"{PRELUDE} SELECT pair, n_pair, n_a, n_b, round(npmi, 6) AS npmi FROM phrases_",
    "concepts_phrase": f"{PRELUDE} SELECT * FROM phrase_",
    "concepts_keyword": f"{PRELUDE} SELECT * FROM keyword_",
    "concepts_ontology": f"{PRELUDE} SELECT * FROM go_",
    "concept_index": f"{PRELUDE} SELECT * FROM word_ UNION ALL SELECT * FROM phrase_ UNION ALL SELECT * FROM keyword_",
    "concept_df": f"{PRELUDE} SELECT layer, concept, count(*) AS n FROM (SELECT * FROM word_ UNION ALL SELECT * FROM phrase_ UNION ALL SELECT * FROM keyword_) GROUP BY ALL",
    "onto_resolve": f"{PRELUDE} SELECT * FROM resolved_",
    "onto_ancestors": f"{PRELUDE} SELECT id, ancestor_id FROM reach_ UNION SELECT id, id FROM nodes_",
    "universe": f"{PRELUDE} SELECT DISTINCT entity_id FROM keyword_",
    "missing_entities": f"{PRELUDE} SELECT set_id, entity_id FROM sets_ WHERE entity_id NOT IN (SELECT entity_id FROM keyword_)",
    "hypergeom": f"{PRELUDE}{enriched('keyword')} SELECT k_study, n_study, k_bg, n_bg, {log('p_value')} AS log_p FROM tails_",
    "bh_fdr": """WITH t AS (SELECT row_no, set_name AS s, p_value AS p, coalesce(k_study, 0) >= 2 AS tested FROM hormones_compare WHERE set_name IS NOT NULL AND p_value IS NOT NULL AND NOT isnan(p_value)),
r AS (SELECT *, p * count(*) OVER (PARTITION BY s) / count(*) OVER (PARTITION BY s ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM t WHERE tested)
SELECT row_no, round(least(1.0, min(raw) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM r UNION ALL SELECT row_no, 1.0 FROM t WHERE NOT tested""",
    "enrich_words": f"{PRELUDE}{enriched('word')} SELECT {ROUNDED} FROM results_",
    "enrich_keywords": f"{PRELUDE}{enriched('keyword')} SELECT {ROUNDED} FROM results_",
    "enrich_terms": f"{PRELUDE}{enriched('go')} SELECT {ROUNDED} FROM results_",
    "enrich_multi": f"{PRELUDE}{enriched('word phrase keyword')} SELECT {ROUNDED} FROM results_",
    "overlap_pairs": f"""{PRELUDE}{EVERY} SELECT s.set_id, least(a.concept, b.concept) AS concept_a, greatest(a.concept, b.concept) AS concept_b, shared
FROM close_ s JOIN cand_ a ON a.set_id = s.set_id AND a.rank = s.rank JOIN cand_ b ON b.set_id = s.set_id AND b.rank = s.earlier""",
    "merge_groups": f"""{PRELUDE}{EVERY} SELECT g.set_id, c.concept, h.concept AS group_concept FROM groups_ g JOIN cand_ c USING (set_id, rank) JOIN cand_ h ON h.set_id = g.set_id AND h.rank = g.group_rank""",
    "significant": f"""{PRELUDE}{EVERY} SELECT set_id, concept, display, merged, k_study, round(fold, 6) AS fold, {log('p_value')} AS p_value, {log('fdr')} AS fdr, genes, symbols FROM described_ WHERE status = 'significant' AND representative""",
    "top_concepts": f"""{PRELUDE}{EVERY} SELECT * FROM (SELECT set_id, status, row_number() OVER (PARTITION BY set_id, status ORDER BY rank) AS place, display, round(fold, 6) AS fold, {log('fdr')} AS fdr FROM described_ WHERE representative)
WHERE place <= CASE status WHEN 'significant' THEN 60 ELSE 25 END""",
    "display_phrase": f"""{PRELUDE}{EVERY} SELECT set_id, concept, display FROM described_ WHERE representative AND layer = 'word'""",
    "compare_top": f"""{PRELUDE}{described('keyword')} SELECT set_id, place, label, {log('fdr')} AS fdr FROM leads_""",
    "compare_grid": f"""{PRELUDE}{described('keyword')}, kept_labels_ AS (SELECT label, arg_min(display, (set_id, place)) AS concept FROM leads_ GROUP BY 1)
SELECT set_id, concept, label, {log('fdr')} AS fdr, {log('p_value')} AS p_value, round(fold, 6) AS fold, k_study, status = 'significant' AS significant
FROM (SELECT d.set_id, d.label, k.concept, d.fdr, d.p_value, d.fold, d.k_study, d.status, row_number() OVER (PARTITION BY d.set_id, d.label ORDER BY d.rank) AS n FROM described_ d JOIN kept_labels_ k USING (label)) WHERE n = 1""",
    "legacy_freq": f"{PRELUDE}{LEGACY} SELECT word, CAST(sum(n) AS BIGINT) AS freq FROM legacy_ GROUP BY 1",
    "legacy_mc": f"""{PRELUDE}{LEGACY},
universe_ AS MATERIALIZED (SELECT DISTINCT entity_id FROM corpus_),
chosen_ AS MATERIALIZED (SELECT DISTINCT set_id, entity_id FROM sets_ SEMI JOIN universe_ USING (entity_id)),
sizes__ AS MATERIALIZED (SELECT set_id, count(*) AS n_study FROM chosen_ GROUP BY 1),
seen_ AS MATERIALIZED (SELECT set_id, word, CAST(sum(n) AS BIGINT) AS freq, any_value(n_study) AS n_study FROM chosen_ JOIN legacy_ USING (entity_id) JOIN sizes__ USING (set_id) GROUP BY 1, 2),
lots_ AS (SELECT sample, entity_id, row_number() OVER (PARTITION BY sample ORDER BY md5('1|' || sample || '|' || entity_id), entity_id) AS place FROM universe_, range(1, 101) s(sample)),
drawn_ AS MATERIALIZED (SELECT word, place, n, sum(n) OVER (PARTITION BY sample, word ORDER BY place) AS so_far FROM lots_ JOIN legacy_ USING (entity_id) WHERE place <= (SELECT max(n_study) FROM sizes__)),
needs_ AS (SELECT DISTINCT word, freq, n_study FROM seen_),
reached_ AS (SELECT word, freq, n_study, count(*) AS rdm FROM needs_ JOIN drawn_ USING (word) WHERE so_far >= freq AND so_far - n < freq AND place <= n_study GROUP BY ALL),
overall_ AS (SELECT word, sum(n) AS genome_count FROM legacy_ GROUP BY 1)
SELECT set_id, word, freq, coalesce(rdm, 0) AS rdm, CAST(genome_count AS BIGINT) AS genome_count, round((freq / n_study) / (genome_count / (SELECT count(*) FROM universe_)), 6) AS enrich_ratio,
 rdm IS NULL AND word NOT IN {listed(NOISE)} AS significant FROM seen_ JOIN overall_ USING (word) LEFT JOIN reached_ USING (word, freq, n_study)""",
}
