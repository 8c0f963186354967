"""SQL (DuckDB) for the queries that it can express, written from their definitions, not from the operators."""

from __future__ import annotations

from lodestrata.llm import conversations, formatdups, lookalikes, textstats


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPEAKER = "CASE " + " ".join(f"WHEN r IN ({', '.join(_quoted(s) for s in spellings.split())}) THEN {_quoted(name)}" for name, spellings in conversations.ROLES.items()) + " ELSE 'unknown' END"

P1_FOUND = rf"""WITH RECURSIVE
lines AS MATERIALIZED (
  SELECT conv_id, node_id, l.created_at AS clock, l.role AS role, l.blank AS blank FROM (
    SELECT conv_id, node_id, arg_min(struct_pack(created_at := created_at, role := {_SPEAKER}, blank := coalesce(regexp_matches(text, {_quoted(conversations.BLANK)}), TRUE)), line_id) AS l
    FROM (SELECT *, lower(regexp_replace(role, '[\s\p{{Z}}\p{{Cf}}:：]+', '', 'g')) AS r FROM chat_lines WHERE conv_id IS NOT NULL AND node_id IS NOT NULL) GROUP BY conv_id, node_id)),
exports AS (SELECT conv_id, mapping FROM chat_conversations WHERE conv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY exported_at DESC NULLS LAST, mapping IS NULL) = 1),
trees AS MATERIALIZED (SELECT conv_id, mapping::JSON AS m FROM exports WHERE mapping IS NOT NULL AND CASE WHEN json_valid(mapping) THEN json_type(mapping) = 'OBJECT' ELSE FALSE END),
entries AS MATERIALIZED (SELECT conv_id, k, e, e->>'parent' AS parent, json_type(e) AS kind, CASE WHEN coalesce(json_type(e->'message'), 'NULL') <> 'NULL' THEN coalesce(e->'message'->>'ref', k) END AS node
  FROM (SELECT conv_id, k, json_extract(m, '$."' || k || '"') AS e FROM (SELECT conv_id, m, unnest(json_keys(m)) AS k FROM trees))),
sound AS (SELECT conv_id, min(k) FILTER (parent IS NULL) AS root, count(*) AS n FROM entries GROUP BY conv_id
  HAVING count(*) FILTER (parent IS NULL) = 1 AND bool_and(kind = 'OBJECT')),
reached AS (SELECT s.conv_id, s.root AS k FROM sound s UNION ALL SELECT r.conv_id, e.k FROM reached r JOIN entries e ON e.conv_id = r.conv_id AND e.parent = r.k),
whole AS (SELECT s.conv_id, s.root FROM sound s JOIN (SELECT conv_id, count(*) AS n FROM reached GROUP BY conv_id) r ON r.conv_id = s.conv_id AND r.n = s.n),
next AS MATERIALIZED (SELECT e.conv_id, e.parent, e.k FROM entries e LEFT JOIN lines l ON l.conv_id = e.conv_id AND l.node_id = e.node WHERE e.parent IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e.conv_id, e.parent ORDER BY CASE WHEN isnan(l.clock) THEN NULL ELSE l.clock END DESC NULLS LAST, coalesce(e.node, '') DESC) = 1),
path AS (SELECT conv_id, root AS k, 0 AS depth FROM whole UNION ALL SELECT p.conv_id, n.k, p.depth + 1 FROM path p JOIN next n ON n.conv_id = p.conv_id AND n.parent = p.k),
walked AS (SELECT p.conv_id, p.depth, e.node, l.role, l.blank FROM path p JOIN entries e ON e.conv_id = p.conv_id AND e.k = p.k LEFT JOIN lines l ON l.conv_id = e.conv_id AND l.node_id = e.node WHERE e.node IS NOT NULL),
mapped AS (SELECT conv_id, node AS node_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY depth) - 1 AS turn_no FROM walked
  WHERE NOT blank AND conv_id NOT IN (SELECT conv_id FROM walked WHERE role IS NULL)),
bare AS (SELECT l.conv_id, l.node_id, l.role, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.clock NULLS LAST, l.node_id) - 1 AS turn_no
  FROM lines l JOIN exports x ON x.conv_id = l.conv_id AND x.mapping IS NULL WHERE NOT l.blank),
turns AS (SELECT * FROM mapped UNION ALL SELECT * FROM bare),
spoken AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn_no) AS following FROM turns WHERE role IN ('user', 'assistant')),
kept AS (SELECT conv_id FROM spoken GROUP BY conv_id HAVING bool_or(role = 'user') AND NOT bool_or(role = 'user' AND coalesce(following, 'user') = 'user'))
SELECT conv_id, CAST(turn_no AS INT) AS turn_no, node_id, role FROM turns WHERE conv_id IN (SELECT conv_id FROM kept)"""


def _folded(x: str) -> str:
    return rf"lower(upper(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'), '[ßẞ]', 'ss', 'g')))"


# A JSON body is compared as the sorted list of its leaves with their paths, a block as the sorted list of its lines.
_P4_GROUPS = rf"""
bodies AS (SELECT DISTINCT hash, content FROM objects WHERE hash IS NOT NULL AND content IS NOT NULL),
trees AS (SELECT b.hash, list_sort(list(regexp_replace(lower(upper(replace(t.fullkey, 'ß', 'ss'))), '[^\p{{L}}\p{{N}}\p{{M}}.\[\]]+', '', 'g') || chr(3) || {_folded("coalesce(t.atom->>'$', 'null')")})) AS leaves
  FROM (SELECT * FROM bodies WHERE regexp_matches(content, '^\s*[{{\[]') AND json_valid(content)) b, json_tree(b.content::JSON) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY b.hash),
blocks AS (SELECT hash, content, regexp_extract(content, {_quoted(formatdups._BLOCK)}, 1) AS block FROM bodies WHERE hash NOT IN (SELECT hash FROM trees)),
texts AS (SELECT hash, CASE WHEN block = '' THEN [] ELSE list_sort(list_transform(list_filter(regexp_split_to_array(block, '\r?\n'), lambda l: regexp_matches(l, '\S')),
    lambda l: {_folded("regexp_replace(l, '[:：].*$', '')")} || chr(3) || {_folded("regexp_extract(l, '[:：](.*)$', 1)")})) END AS fields,
  {_folded(f"CASE WHEN block = '' THEN content ELSE regexp_replace(content, {_quoted(formatdups._BLOCK)}, '') END")} AS rest FROM blocks),
keyed AS (SELECT hash, 'j' AS kind, leaves AS fields, '' AS rest FROM trees UNION ALL SELECT hash, 't', fields, rest FROM texts),
grouped AS (SELECT hash, min(hash) OVER (PARTITION BY kind, fields, rest) AS rep_hash FROM keyed)"""

P4_FOUND = f"WITH {_P4_GROUPS} SELECT rep_hash, hash FROM grouped WHERE hash <> rep_hash"

P4_COPIES = f"""WITH {_P4_GROUPS}, stored AS (SELECT hash, count(*) AS n FROM objects WHERE content IS NOT NULL GROUP BY hash)
SELECT rep_hash, count(*) AS n_copies, CAST(sum(n) AS BIGINT) AS n_rows FROM grouped JOIN stored USING (hash) GROUP BY rep_hash"""

_LETTERS = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"

# Any half of an item holds one of its pieces of a quarter's length whole, if pieces begin at every such length.
P8_FOUND = f"""WITH items AS (SELECT item_id, {_LETTERS.format('min(text)')} AS x FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id),
sized AS (SELECT item_id, x, (length(x) + 1) // 2 AS need, greatest(1, ((length(x) + 1) // 2 + 1) // 2) AS step FROM items WHERE length(x) > 0),
docs AS MATERIALIZED (SELECT DISTINCT doc_id, {_LETTERS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT item_id, x, need, substring(x, CAST(p * step + 1 AS INT), CAST(step AS INT)) AS piece FROM (SELECT *, unnest(range(0, length(x) // step)) AS p FROM sized)),
near AS (SELECT DISTINCT d.doc_id, d.t, p.item_id, p.x, p.need FROM docs d JOIN pieces p ON contains(d.t, p.piece))
SELECT DISTINCT doc_id, item_id FROM near WHERE len(list_filter(range(1, length(x) - need + 2), lambda i: contains(t, substring(x, CAST(i AS INT), CAST(need AS INT))))) > 0"""

_SINGLE = [c for c in [*lookalikes._WIDE, *lookalikes._ALIKE] if len(lookalikes._plain(chr(c))) == 1 and lookalikes._plain(chr(c)) != chr(c)]
_SOURCE = "".join(map(chr, _SINGLE)) + lookalikes._HYPHENS + lookalikes._SPACES + lookalikes._BREAKS
_TARGET = "".join(lookalikes._plain(chr(c)) for c in _SINGLE) + "-" * len(lookalikes._HYPHENS) + " " * len(lookalikes._SPACES) + "\n" * len(lookalikes._BREAKS)
_SEVERAL = [chr(c) for c in lookalikes._ALIKE if len(lookalikes._plain(chr(c))) > 1]
_UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}\x{0001}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}]"


def _seen(x: str) -> str:
    out = f"translate(regexp_replace(regexp_replace({x}, {_quoted(_UNSEEN)}, '', 'g'), '\\r\\n?', chr(10), 'g'), {_quoted(_SOURCE)}, {_quoted(_TARGET)})"
    for char in _SEVERAL:
        out = f"replace({out}, {_quoted(char)}, {_quoted(lookalikes._plain(char))})"
    return rf"regexp_replace(regexp_replace(nfc_normalize({out}), '^[ \n]+|[ \n]+$', '', 'g'), ' +\n', chr(10), 'g')"


_LETTER = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{M}]"
_FOREIGN_LETTER = r"[\p{Greek}\p{Cyrillic}\p{Armenian}]"


def _to(script: str) -> str:
    latin = f"translate(token, {_quoted(lookalikes.FOREIGN)}, {_quoted(lookalikes.LATIN)})"
    if script == "Latin":
        return f"nfc_normalize({latin})"
    table = lookalikes.TO_SCRIPT[script.lower()]
    return f"nfc_normalize(translate({latin}, {_quoted(''.join(map(chr, table)))}, {_quoted(''.join(v if isinstance(v, str) else chr(v) for v in table.values()))}))"


_SCRIPTS = ["Armenian", "Cyrillic", "Greek", "Latin"]
_OPTIONS = " UNION ALL ".join(
    rf"SELECT token, script, {_quoted(x.lower())} AS target, {_to(x)} AS option, len(regexp_extract_all(token, '\p{{{x}}}')) AS letters, regexp_full_match({_to(x)}, '[\p{{{x}}}\p{{M}}]+') AS pure FROM asked" for x in _SCRIPTS
)

# The text's script first, then the token's own by number of letters; only what stands in the corpus as a token of one script.
_P3_FORMS = rf"""WITH raw AS (SELECT DISTINCT 'title' AS field_name, id AS record_key, title AS raw FROM sources WHERE id IS NOT NULL AND title IS NOT NULL UNION SELECT 'content', id, content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL),
seen AS MATERIALIZED (SELECT *, {_seen('raw')} AS form FROM raw),
doubted AS MATERIALIZED (SELECT DISTINCT form, CASE WHEN NOT regexp_matches(translate(form, {_quoted(lookalikes.FOREIGN)}, ''), {_quoted(_FOREIGN_LETTER)}) OR (l >= g AND l >= c) THEN 'latin' WHEN c >= g THEN 'cyrillic' ELSE 'greek' END AS script
  FROM (SELECT form, len(regexp_extract_all(form, '\p{{Latin}}')) AS l, len(regexp_extract_all(form, '\p{{Greek}}')) AS g, len(regexp_extract_all(form, '\p{{Cyrillic}}')) AS c FROM seen WHERE regexp_matches(form, {_quoted(_FOREIGN_LETTER)}))),
pieces AS MATERIALIZED (SELECT form, script, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM (SELECT *, regexp_extract_all(form, '{_LETTER}+|[^\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Armenian}}\p{{M}}]+') AS p FROM doubted)),
asked AS (SELECT DISTINCT piece AS token, script FROM pieces WHERE regexp_matches(piece, {_quoted(_FOREIGN_LETTER)})),
vocabulary AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(form, '{_LETTER}+')) AS word FROM (SELECT DISTINCT form FROM seen)),
options AS ({_OPTIONS}),
mixed AS (SELECT token, script, count(*) FILTER (letters > 0) AS n_scripts, bool_or(letters > 0 AND target = script) AS own FROM options GROUP BY token, script),
chosen AS (SELECT o.token, o.script, arg_min(o.option, CASE WHEN o.target = o.script THEN -1000000 ELSE -o.letters END) AS repair FROM options o JOIN mixed m ON m.token = o.token AND m.script = o.script
  WHERE NOT (m.n_scripts < 2 AND m.own) AND o.pure AND o.option <> o.token AND (o.target = o.script OR o.letters > 0) AND o.option IN (SELECT word FROM vocabulary) GROUP BY o.token, o.script),
repaired AS (SELECT p.form, string_agg(coalesce(c.repair, p.piece), '' ORDER BY p.n) AS fixed FROM pieces p LEFT JOIN chosen c ON c.token = p.piece AND c.script = p.script GROUP BY p.form),
final AS MATERIALIZED (SELECT s.field_name, s.record_key, s.raw, coalesce(r.fixed, s.form) AS form FROM seen s LEFT JOIN repaired r USING (form))"""

P3_FOUND = f"""{_P3_FORMS}, several AS (SELECT field_name, form FROM final GROUP BY field_name, form HAVING count(DISTINCT raw) > 1)
SELECT DISTINCT a.field_name, least(a.record_key, b.record_key) AS key_a, greatest(a.record_key, b.record_key) AS key_b FROM (SELECT * FROM final JOIN several USING (field_name, form)) a
  JOIN final b ON a.field_name = b.field_name AND a.form = b.form AND a.raw < b.raw AND a.record_key <> b.record_key"""

P3_CLASSES = f"""{_P3_FORMS}, classes AS (SELECT field_name, form, count(*) AS n_records, count(DISTINCT raw) AS n_strings FROM final GROUP BY field_name, form HAVING count(DISTINCT raw) > 1)
SELECT DISTINCT field_name, upper(md5(form)) AS form_id, record_key, n_records, n_strings FROM final JOIN classes USING (field_name, form)"""

# Every stored row has its form.
P3_FORMS = f"""{_P3_FORMS} SELECT s.field_name, s.record_key, f.form FROM (SELECT 'title' AS field_name, id AS record_key, title AS raw FROM sources UNION ALL SELECT 'content', id, content FROM chunks) s
  LEFT JOIN final f ON f.field_name = s.field_name AND f.record_key = s.record_key AND f.raw = s.raw"""

# Han characters become one of them, broken ones a sign, so that classes are Unicode's.
_HAN = r"[\x{2E80}-\x{2FDF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
_BROKEN = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in textstats.BROKEN) + "]"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(x, {_quoted(pattern)}))"


_ENDED = f"[{textstats.ENDS}]$|[{textstats.ENDS}][{textstats.QUOTES.replace(']', chr(92) + ']')}]$"

P9_RATIOS = rf"""WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(regexp_replace(coalesce(text, ''), {_quoted(_BROKEN)}, '+', 'g'), {_quoted(_HAN)}, '一', 'g') AS x FROM documents),
counted AS (SELECT doc_id, n_chars, regexp_replace(x, '一', ' ', 'g') AS spaced, len(regexp_extract_all(x, '一')) AS n_han, {_count(r'[^\p{Z}\p{Cc}\p{Cf}\p{Cs}]')} AS n_shown, {_count(r'\p{N}')} AS n_digits, {_count(r'\p{P}')} AS n_punct, {_count(r'[\p{S}\p{Co}]')} AS n_symbols,
  list_filter(list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '[\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '')), lambda l: regexp_matches(l, '[^\p{{Z}}\p{{Cc}}\p{{Cf}}]') AND NOT regexp_matches(l, '^[\p{{Z}}\p{{Cc}}\p{{Cf}}]*#(?:[\p{{Z}}\p{{Cc}}]|$|#(?:[\p{{Z}}\p{{Cc}}]|$|#))')) AS lines FROM plain),
runs AS (SELECT *, regexp_extract_all(spaced, '[\p{{L}}\p{{M}}\p{{N}}]+') AS words FROM counted)
SELECT doc_id, n_chars, len(words) + n_han AS n_words, len(lines) AS n_lines, CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words) ELSE 0 END AS mean_word_length,
  n_symbols::DOUBLE / greatest(n_shown, 1) AS symbol_ratio, n_digits::DOUBLE / greatest(n_shown, 1) AS digit_ratio, n_punct::DOUBLE / greatest(n_shown, 1) AS punct_ratio,
  len(list_filter(lines, lambda l: regexp_matches(l, {_quoted(_ENDED)})))::DOUBLE / greatest(len(lines), 1) AS end_punct_share FROM runs"""

ORACLE_SQL = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_forms": P3_FORMS, "p3_classes": P3_CLASSES, "p4_found": P4_FOUND, "p4_copies": P4_COPIES, "p8_found": P8_FOUND, "p9_ratios": P9_RATIOS}
