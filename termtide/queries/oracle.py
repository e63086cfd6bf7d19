"""The queries of ``catalog`` in SQL, over the same tables.

Written from the meaning of each operator, by brute force where that is plainer:
a curve scans all scores for each point, a prefix is matched by comparing strings.
"""

from __future__ import annotations

# Stand-in inputs: the rules of ``standins`` in SQL.
_BASE = r"""
lines AS (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents
),
entries AS (
    SELECT doc_id * 100000 + pos AS id, 'd' || CAST(doc_id % 2 AS VARCHAR) AS dictionary,
           lower(regexp_extract(text, '(\p{L}+)', 1)) AS word, text,
           CAST(length(text) % 13 - 2 AS BIGINT) AS quality, lang, CAST(pos AS BIGINT) AS pos
    FROM lines WHERE regexp_extract(text, '(\p{L}+)', 1) <> ''
),
word_langs AS (SELECT word, lang, count(*) AS n FROM entries GROUP BY word, lang),
lexicon AS (
    SELECT word, lang AS label, row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) AS ord
    FROM word_langs WHERE n >= 2
),
lists AS (SELECT word, string_agg(label, '|' ORDER BY ord) AS labels FROM lexicon GROUP BY word),
firsts AS (SELECT word, label FROM lexicon WHERE ord = 1),
tree(child, parent) AS (
    VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance'),
           ('germanic', 'european'), ('romance', 'european'), ('european', NULL)
),
starts AS (
    SELECT stem, label FROM (
        SELECT left(word, 3) AS stem, label, count(*) AS n FROM firsts
        WHERE length(word) >= 3 GROUP BY 1, 2
    ) QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, label DESC) = 1
),
patterns AS (
    SELECT stem || '*' AS pattern, true AS is_prefix, label FROM starts
    UNION ALL
    SELECT word, false, label FROM firsts WHERE length(word) % 3 = 0
),
frequent AS (
    SELECT word AS term FROM entries GROUP BY word ORDER BY count(*) DESC, word LIMIT 50
),
main_lang AS (
    SELECT word, lang AS label_out, n / sum(n) OVER (PARTITION BY word) AS prob_out FROM word_langs
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) = 1
),
scored AS (
    SELECT id, dictionary, word, text, quality, lang AS label, label_out, prob_out
    FROM entries JOIN main_lang USING (word)
),
votes AS (
    SELECT id, word, quality,
           replace(replace(text, ' ', CASE WHEN id % 3 = 0 THEN '+' ELSE '%20' END)
                   || CASE WHEN id % 7 = 0 THEN '%zz' ELSE '' END, '|', '/') AS meaning,
           'an%20example+here' AS example,
           CASE WHEN id % 10 = 0 THEN '' ELSE CAST(length(text) % 50 AS VARCHAR) END AS likes,
           CAST(pos % 7 AS VARCHAR) AS dislikes, '#' || upper(lang) AS tags
    FROM entries
),
decoded AS (
    SELECT id, word, url_decode(replace(meaning, '+', ' ')) AS meaning, 'an example here' AS example,
           likes, dislikes, lower(replace(tags, '#', ' ')) AS tags
    FROM votes
),
cleaned AS (
    SELECT id, word,
           regexp_replace(tags || ' ' || meaning || ' ' || example, '^\s+|\s+$', '', 'g') AS text,
           CAST(likes AS BIGINT) - CAST(dislikes AS BIGINT) AS quality
    FROM decoded WHERE regexp_matches(likes, '^[0-9]+') AND regexp_matches(dislikes, '^[0-9]+')
),
turns AS (
    SELECT u.conv_id, u.turn, u.text, a.text AS answer
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'
),
labelled AS (SELECT entries.*, label FROM entries JOIN firsts USING (word))
"""

# Valid entries, quotas, test vocabulary and the two sets.
_SPLIT = """
allowed AS (
    SELECT * FROM labelled WHERE word NOT IN (SELECT term FROM frequent)
),
valid AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY dictionary, word ORDER BY id) AS rn FROM allowed
    ) WHERE rn <= 10 AND quality >= 0
),
{prefix}sizes AS (
    SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {source} GROUP BY label
),
{prefix}target AS (
    SELECT {target} AS target
),
{prefix}rounded AS (
    SELECT label, n, share, CAST(round_even(target * share, 0) AS BIGINT) AS quota,
           CAST(target AS BIGINT) AS target
    FROM {prefix}sizes, {prefix}target
),
{prefix}ordered AS (
    SELECT *, row_number() OVER (ORDER BY md5('0:' || label), label) - 1 AS turn,
           count(*) OVER () AS labels, greatest(target - sum(quota) OVER (), 0) AS short
    FROM {prefix}rounded
),
{prefix}quotas AS (
    SELECT label, n, share,
           CAST(quota + short // labels + CASE WHEN turn < short % labels THEN 1 ELSE 0 END AS BIGINT) AS quota
    FROM {prefix}ordered
),
{prefix}common AS (
    SELECT word, min(label) AS label FROM {source} GROUP BY word HAVING count(DISTINCT dictionary) = 2
),
{prefix}picked AS (
    SELECT word, label FROM (
        SELECT word, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || word), word) AS rn
        FROM {prefix}common
    ) JOIN {prefix}quotas USING (label) WHERE rn <= quota
)
"""

_SHARE = "round_even(0.1 * (SELECT count(*) / count(DISTINCT dictionary) FROM {source}), 0)"


def _split(source: str, target: str, prefix: str = "") -> str:
    text = _SPLIT.format(source=source, target=target.format(source=source), prefix=prefix)
    # the entries come first and only once
    return text if not prefix else text[text.index(f"{prefix}sizes") :]


_SETS = (
    _split("valid", _SHARE)
    + """,
test AS (
    SELECT * EXCLUDE (rn, best) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY dictionary, word
            ORDER BY quality DESC, md5('0:' || CAST(id AS VARCHAR)), id) AS best
        FROM valid WHERE word IN (SELECT word FROM picked)
    ) WHERE best = 1
),
train AS (SELECT * EXCLUDE (rn) FROM valid WHERE word NOT IN (SELECT word FROM picked)),
dataset AS (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'test' FROM test)
"""
)

_LABEL_INDEX = """
label_index AS (SELECT DISTINCT label FROM dataset)
"""

# Naive Bayes with add-one smoothing; scores in long form, one row per class.
_MODEL = r"""
tokens AS (
    SELECT dictionary, label, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM train
),
vocabulary AS (SELECT DISTINCT dictionary, token FROM tokens),
cells AS (
    SELECT v.dictionary, v.token, l.label, count(t.token) AS n
    FROM vocabulary v CROSS JOIN label_index l
    LEFT JOIN tokens t ON t.dictionary = v.dictionary AND t.token = v.token AND t.label = l.label
    GROUP BY ALL
),
weights AS (
    SELECT dictionary, token, label,
           ln(CAST(n + 1 AS DOUBLE) / (sum(n) OVER (PARTITION BY dictionary, label)
              + count(*) OVER (PARTITION BY dictionary, label))) AS w
    FROM cells
),
priors AS (
    SELECT d.dictionary, l.label, ln(CAST(nullif(count(t.id), 0) AS DOUBLE) / d.n) AS w
    FROM (SELECT dictionary, count(*) AS n FROM train GROUP BY dictionary) d CROSS JOIN label_index l
    LEFT JOIN train t ON t.dictionary = d.dictionary AND t.label = l.label
    GROUP BY d.dictionary, l.label, d.n
)
"""

_MODEL_ROWS = """
SELECT dictionary, token, label, round(w, 6) AS w FROM weights
UNION ALL
SELECT dictionary, '', label, round(coalesce(w, CAST('-inf' AS DOUBLE)), 6) FROM priors
"""


def _scores(source: str, out: str, keep: str) -> str:
    """Class, probability and ``keep`` columns of each entry of ``source`` as ``out``."""
    return rf"""
{out}_tokens AS (
    SELECT dictionary, id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token FROM {source}
),
{out}_sums AS (
    SELECT t.dictionary, t.id, w.label, sum(w.w) AS s
    FROM {out}_tokens t JOIN weights w ON w.dictionary = t.dictionary AND w.token = t.token
    GROUP BY t.dictionary, t.id, w.label
),
{out}_logs AS (
    SELECT e.dictionary, e.id, p.label, p.w + coalesce(s.s, 0) AS s
    FROM {source} e JOIN priors p ON p.dictionary = e.dictionary
    LEFT JOIN {out}_sums s ON s.dictionary = e.dictionary AND s.id = e.id AND s.label = p.label
    WHERE p.w IS NOT NULL
),
{out}_probs AS (
    SELECT dictionary, id, label AS label_out, s,
           exp(s - max(s) OVER one) / sum(exp(s - m)) OVER one AS prob_out
    FROM (SELECT *, max(s) OVER (PARTITION BY dictionary, id) AS m FROM {out}_logs)
    WINDOW one AS (PARTITION BY dictionary, id)
),
{out} AS (
    SELECT p.dictionary, p.id, label_out, prob_out {keep}
    FROM (SELECT * FROM {out}_probs
          QUALIFY row_number() OVER (PARTITION BY dictionary, id ORDER BY s DESC, label_out) = 1) p
    JOIN {source} e ON e.dictionary = p.dictionary AND e.id = p.id
)
"""


_TEST_SCORED = _scores("test", "test_scored", ", e.word, e.label")
_ALL_SCORED = _scores("entries", "all_scored", ", e.word, e.quality")


def _report(source: str, labels: str, out: str, by: str = "") -> str:
    """Per-label scores of ``source`` as ``out``; ``labels`` gives labels to list besides."""
    key = f"{by}, " if by else ""
    return f"""
{out}_labels AS (
    SELECT {key}label FROM {source} UNION SELECT {key}label_out FROM {source} UNION {labels}
),
{out}_counts AS (
    SELECT {", ".join(f"l.{c}" for c in (by, "label") if c)},
        count(*) FILTER (s.label = l.label AND s.label_out = l.label) AS hit,
        count(*) FILTER (s.label = l.label) AS support,
        count(*) FILTER (s.label_out = l.label) AS guessed
    FROM {out}_labels l LEFT JOIN {source} s
      ON (s.label = l.label OR s.label_out = l.label) {f"AND s.{by} = l.{by}" if by else ""}
    GROUP BY ALL
),
{out} AS (
    SELECT {key}label, coalesce(hit / nullif(guessed, 0), 0) AS precision,
           coalesce(hit / nullif(support, 0), 0) AS recall,
           coalesce(CAST(2 * hit AS DOUBLE) / nullif(guessed + support, 0), 0) AS f1, support
    FROM {out}_counts
)
"""


def _report_rows(out: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {key}label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM {out}
UNION ALL
SELECT {key}'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM {out} {group}
UNION ALL
SELECT {key}'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM {out} {group}
"""


_SUMMARY = (
    _TEST_SCORED
    + ","
    + _ALL_SCORED
    + ","
    + _report("test_scored", "SELECT DISTINCT dictionary, label FROM train", "full_report", "dictionary")
    + ","
    + _report("test_scored", "SELECT dictionary, label FROM test_scored", "seen_report", "dictionary")
    + """,
fresh AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY dictionary, word ORDER BY prob_out DESC, id) AS best
        FROM all_scored WHERE word NOT IN (SELECT word FROM lexicon) AND quality > 0
    ) WHERE best = 1
),
summary AS (
    SELECT t.dictionary, t.train_count, f.f_score, m.macro_precision, m.macro_recall, s.accuracy,
           s.precision, s.coverage, coalesce(n.new_terms, 0) AS new_terms
    FROM (SELECT dictionary, count(*) AS train_count FROM train GROUP BY 1) t
    JOIN (SELECT dictionary, round(avg(f1), 6) AS f_score FROM seen_report GROUP BY 1) f USING (dictionary)
    JOIN (SELECT dictionary, round(avg(precision), 6) AS macro_precision,
                 round(avg(recall), 6) AS macro_recall FROM full_report GROUP BY 1) m USING (dictionary)
    JOIN (SELECT dictionary, round(avg(CASE WHEN label = label_out THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
                 round(coalesce(count(*) FILTER (prob_out >= 0.8 AND label = label_out)
                       / nullif(count(*) FILTER (prob_out >= 0.8), 0), 0), 6) AS precision,
                 round(count(*) FILTER (prob_out >= 0.8) / count(*), 6) AS coverage
          FROM test_scored GROUP BY 1) s USING (dictionary)
    LEFT JOIN (SELECT dictionary, count(*) FILTER (prob_out >= 0.8) AS new_terms FROM fresh GROUP BY 1) n
      USING (dictionary)
)
"""
)


def _grown(source: str, out: str, by: str = "dictionary, ") -> str:
    """New terms with the label of their last confident entry."""
    return f"""
{out} AS (
    SELECT {by}word AS term, label_out AS label, prob_out FROM (
        SELECT *, row_number() OVER (PARTITION BY {by}word ORDER BY id DESC) AS last
        FROM {source} WHERE prob_out >= {{threshold}}
    ) WHERE last = 1 AND word NOT IN (SELECT word FROM lexicon)
)
"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(part for part in parts)


_B = _with(_BASE)
_D = _with(_BASE, _SETS)
_I = _with(_BASE, _SETS, _LABEL_INDEX)
_M = _with(_BASE, _SETS, _LABEL_INDEX, _MODEL)

_ROLLUP = """
up(label, node, depth) AS (
    SELECT child, parent, 1 FROM tree WHERE child NOT IN ({used})
    UNION ALL
    SELECT up.label, tree.parent, depth + 1 FROM up JOIN tree ON tree.child = up.node
    WHERE up.node NOT IN ({used})
),
moves AS (
    SELECT child AS label, child AS used FROM tree WHERE child IN ({used})
    UNION ALL
    SELECT label, node FROM up WHERE node IN ({used})
),
rolled AS (
    SELECT word, used AS label, min(ord) AS ord
    FROM lexicon JOIN moves USING (label) GROUP BY word, used
),
rolled_lists AS (SELECT word, string_agg(label, '|' ORDER BY ord) AS labels FROM rolled GROUP BY word)
"""

# Encoding: the stand-in vocabulary, and for each place of a word the longest piece that fits there.
_MARKS = r"[\p{P}$+<=>^`|~]"
_PIECES = rf"""
word_counts AS (SELECT word, count(*) AS n FROM entries GROUP BY word),
pieces AS (
    SELECT piece, row_number() OVER (ORDER BY part, place, piece) - 1 AS id FROM (
        SELECT 0 AS part, i AS place, p AS piece
        FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]')) AS v(i, p)
        UNION ALL
        SELECT 1, 0, piece FROM (
            SELECT unnest([c, '##' || c]) AS piece FROM (SELECT unnest(string_split(word, '')) AS c FROM word_counts)
            UNION
            SELECT * FROM (SELECT word FROM word_counts WHERE regexp_full_match(word, '[a-z]{{2,}}') ORDER BY n DESC, word LIMIT 600)
            UNION
            SELECT piece FROM (
                SELECT '##' || right(word, 3) AS piece, sum(n) AS n FROM word_counts
                WHERE regexp_full_match(word, '[a-z]{{4,}}') GROUP BY 1 ORDER BY n DESC, piece LIMIT 600
            )
        )
    )
),
text_words AS MATERIALIZED (
    SELECT dictionary, id, w, unnest(range(1, len(w) + 1)) AS nth, unnest(w) AS word FROM (
        SELECT dictionary, id, regexp_extract_all(strip_accents(lower(text)), '{_MARKS}|[^\s\p{{P}}$+<=>^`|~]+') AS w FROM entries
    )
),
fitting AS MATERIALIZED (
    SELECT word, pos, max(size) AS size, arg_max(p.id, size) AS id FROM (
        SELECT word, pos, unnest(range(1, least(length(word) - pos + 1, 40) + 1)) AS size
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM (SELECT DISTINCT word FROM text_words))
    ) JOIN pieces p ON p.piece = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, size)
    GROUP BY word, pos
),
cuts(word, pos, ids) AS (
    SELECT DISTINCT word, 1, CAST([] AS BIGINT[]) FROM text_words
    UNION ALL
    SELECT cuts.word, cuts.pos + f.size, list_append(ids, f.id)
    FROM cuts JOIN fitting f ON f.word = cuts.word AND f.pos = cuts.pos
),
word_ids AS (
    SELECT word, coalesce(max(ids) FILTER (pos > length(word) AND length(word) <= 100), [1]) AS ids FROM cuts GROUP BY word
),
encoded AS MATERIALIZED (
    SELECT e.dictionary, e.id, list_concat([2], list_concat(coalesce(ids, [])[:22], [3])) AS ids
    FROM entries e LEFT JOIN (
        SELECT dictionary, id, flatten(list(ids ORDER BY nth)) AS ids FROM text_words JOIN word_ids USING (word) GROUP BY 1, 2
    ) USING (dictionary, id)
)
"""

EPOCHS, RATE = 3, 4.0


def _softmax() -> str:
    """Training as one table of weights after the other."""
    steps = [
        """
shares AS MATERIALIZED (
    SELECT dictionary, id, label AS truth, piece, count(*) / sum(count(*)) OVER (PARTITION BY dictionary, id) AS x
    FROM (SELECT dictionary, id, t.label, unnest(ids) AS piece FROM train t JOIN encoded USING (dictionary, id)) GROUP BY dictionary, id, label, piece
),
trained AS (SELECT dictionary, count(DISTINCT id) AS n FROM shares GROUP BY 1),
slopes0 AS (SELECT DISTINCT dictionary, piece, label FROM shares, label_index),
after0 AS MATERIALIZED (SELECT dictionary, piece, label, 0::DOUBLE AS w FROM slopes0)"""
    ]
    for e in range(1, EPOCHS + 1):
        steps.append(f"""
logits{e} AS (
    SELECT s.dictionary, s.id, truth, label, sum(x * w) AS z
    FROM shares s JOIN after{e - 1} a ON a.dictionary = s.dictionary AND a.piece = s.piece GROUP BY s.dictionary, s.id, truth, label
),
errors{e} AS (
    SELECT dictionary, id, label, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY dictionary, id)
           - CASE WHEN label = truth THEN 1 ELSE 0 END AS d
    FROM (SELECT *, max(z) OVER (PARTITION BY dictionary, id) AS m FROM logits{e})
),
after{e} AS MATERIALIZED (
    SELECT a.dictionary, a.piece, a.label, any_value(a.w) - {RATE} * sum(x * d) / any_value(n) AS w
    FROM after{e - 1} a JOIN shares s ON s.dictionary = a.dictionary AND s.piece = a.piece
    JOIN errors{e} r ON r.dictionary = s.dictionary AND r.id = s.id AND r.label = a.label
    JOIN trained z ON z.dictionary = a.dictionary GROUP BY a.dictionary, a.piece, a.label
)""")
    return ",".join(steps)


_SOFTMAX_SCORED = f"""
all_shares AS (
    SELECT dictionary, id, piece, count(*) / sum(count(*)) OVER (PARTITION BY dictionary, id) AS x
    FROM (SELECT dictionary, id, unnest(ids) AS piece FROM encoded) GROUP BY dictionary, id, piece
),
all_logits AS (
    SELECT s.dictionary, s.id, l.label, sum(x * coalesce(w, 0)) AS z
    FROM all_shares s CROSS JOIN label_index l
    LEFT JOIN after{EPOCHS} a ON a.dictionary = s.dictionary AND a.piece = s.piece AND a.label = l.label GROUP BY s.dictionary, s.id, l.label
),
all_probs AS (
    SELECT dictionary, id, label AS label_out, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY dictionary, id) AS prob_out
    FROM (SELECT *, max(z) OVER (PARTITION BY dictionary, id) AS m FROM all_logits)
)
"""

def _feistel(x: str, source: str, keep: str) -> str:
    """``keep, x``: one pass of the network over ``source``, round by round; ``bits`` is a column of it."""
    inner = f"SELECT {keep}, bits, n, ({x}) >> (bits // 2) AS h, ({x}) & ((1 << (bits // 2)) - 1) AS l FROM {source}"
    for turn in range(4):
        other, changed, size = ("l", "h", "(bits - bits // 2)") if turn % 2 == 0 else ("h", "l", "(bits // 2)")
        value = f"('0x' || substr(md5('0:{turn}:' || {other}), 1, 8))::BIGINT % (1::BIGINT << {size})"
        parts = {"h": "h", "l": "l", changed: f"xor({changed}, {value})"}
        inner = f"SELECT {keep}, bits, n, {parts['h']} AS h, {parts['l']} AS l FROM ({inner})"
    return f"SELECT {keep}, bits, n, (h << (bits // 2)) | l AS x FROM ({inner})"


_PERMUTED = f"""
places AS (
    SELECT id, word, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n,
           greatest(2, length(bin(count(*) OVER () - 1)))::BIGINT AS bits FROM entries
),
walked(id, word, bits, n, x) AS (
    {_feistel("r", "places", "id, word")}
    UNION ALL
    {_feistel("x", "(SELECT * FROM walked WHERE x >= n)", "id, word")}
)
"""

_LABELS_TEXT = "en, de"
_ASKED = (
    """'which label should be assigned to the word "' || word || '" from the following """
    """"languages" labels: de, en, es, fr?'"""
)
_CONTEXT = f"""'In the following context: ' || chr(10) || '"' || text || '", ' || chr(10) || {_ASKED}"""


def _details(meaning: str, example: str) -> str:
    return (
        "'For a word with the following meaning: ' || chr(10) || '\"' || "
        f"{meaning} || chr(10) || '\"' || 'in this example: ' || chr(10) || '\"' || {example}"
        f" || '\" ' || chr(10) || {_ASKED}"
    )


_ANSWER_ORDER = [("the", 0), ("der", 1), ("que", 2), ("les", 3), ("ando", 4), ("de", 5)]
_ANSWER_VALUES = ", ".join(f"('{label}', {i})" for label, i in _ANSWER_ORDER)

ORACLE: dict[str, str] = {
    # --- sources
    "src_lexicon_csv": f"{_B} SELECT word, labels FROM lists",
    "src_lexicon_dic": f"""{_B} SELECT word AS stem, length(word) % 2 = 0 AS is_prefix, labels FROM lists""",
    "src_lexicon_pipe": f"""{_B}
        SELECT word, coalesce(string_agg(label, '|' ORDER BY ord) FILTER (label IN ('en', 'fr')), '') AS labels
        FROM lexicon GROUP BY word""",
    "src_lexicon_wide": f"""{_B}
        SELECT word, string_agg(lang, '|' ORDER BY lang) AS labels
        FROM word_langs GROUP BY word HAVING sum(n) > 1""",
    "src_dictionary_csv": f"{_B} SELECT id, word, text, quality FROM entries",
    "src_dictionary_votes": f"""{_B}
        SELECT line - 1 AS id, word, text, quality FROM cleaned JOIN
            (SELECT id, row_number() OVER (ORDER BY id) AS line FROM entries) USING (id)""",
    "src_dictionary_reviewed": f"""{_B}
        SELECT id, word, regexp_replace(
            CASE WHEN quality > 0 THEN text ELSE '' END || ' '
            || CASE WHEN quality < 5 THEN 'see "this", ' || word ELSE '' END,
            '^\\s+|\\s+$', '', 'g') AS text, CAST(100 AS BIGINT) AS quality
        FROM entries""",
    "src_dictionary_pos": f"""{_B}
        SELECT row_number() OVER (ORDER BY id) - 1 AS id, word,
               CASE WHEN quality % 2 = 0 THEN 'n.' ELSE 'v.' END AS pos,
               CASE WHEN quality <> 3 THEN text ELSE '' END AS text
        FROM entries""",
    "src_term_list": f"{_B} SELECT DISTINCT word AS term FROM entries",
    "src_dataset": f"{_D} SELECT dictionary, id, word, label, split FROM dataset",
    "src_scored": f"""{_B} SELECT dictionary, id, label_out, round(prob_out, 6) AS prob_out
        FROM scored""",
    "src_answers": f"""{_B} SELECT word AS key, CAST(max(id) AS VARCHAR) AS value
        FROM entries GROUP BY word""",
    # --- sinks
    "sink_dictionary": f"{_B} SELECT id, word, text, quality FROM cleaned",
    "sink_dataset": f"""{_D}
        SELECT CASE WHEN split = 'train' AND id % 10 = 9 THEN 'valid' ELSE split END AS split, label,
               count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
        FROM dataset GROUP BY 1, 2""",
    "sink_scored": f"""{_B} SELECT dictionary, label_out, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
        FROM scored GROUP BY 1, 2""",
    "sink_expanded": _with(_BASE, _grown("scored", "grown", "").format(threshold=0.8))
    + " SELECT term, label FROM grown",
    "sink_answers": f"""{_B}
        SELECT 'echo' AS model, sha256(text) AS prompt_hash, min(answer) AS answer
        FROM turns GROUP BY text""",
    "sink_manifest": f"""{_B}
        SELECT '{{"exp_name": "demo", "sep": ","}}' AS conf, count(*) AS entries,
               count(DISTINCT word) AS words,
               (SELECT count(DISTINCT label) FROM lexicon) AS label_count,
               (SELECT string_agg(DISTINCT label, '|' ORDER BY label) FROM lexicon) AS labels
        FROM entries""",
    # --- projections
    "xf_url_decode": f"{_B} SELECT id, meaning FROM decoded",
    "xf_fold_case": f"{_B} SELECT id, lower(text) AS folded FROM entries",
    "xf_fill_text": f"{_B} SELECT id, CASE WHEN quality > 3 THEN text ELSE '' END AS text FROM entries",
    "xf_compose_text": rf"""{_B}
        SELECT id, regexp_replace(tags || ' ' || meaning || ' ' || 'an%20example+here',
                                  '^\s+|\s+$', '', 'g') AS text
        FROM (SELECT id, lower(replace(tags, '#', ' ')) AS tags, meaning FROM votes)""",
    "xf_net_quality": f"{_B} SELECT id, quality FROM cleaned",
    "xf_constant_quality": f"{_B} SELECT id, CAST(100 AS BIGINT) AS quality FROM entries",
    "xf_strip_wildcard": f"{_B} SELECT pattern, rtrim(pattern, '*') AS stem FROM patterns",
    "xf_strict_patterns": f"""{_B}
        SELECT rtrim(pattern, '*') AS word, arg_max(label, is_prefix::INT) AS labels FROM patterns GROUP BY 1""",
    "xf_label_subset": f"""{_B}
        SELECT word, coalesce(string_agg(label, '|' ORDER BY ord) FILTER (label IN ('en', 'fr')), '') AS labels
        FROM lexicon GROUP BY word""",
    "xf_first_label": f"{_B} SELECT id, label FROM labelled",
    "xf_softmax_argmax": """
        WITH long AS (
            SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS s,
                   generate_subscripts(embedding, 1) AS i FROM embeddings
        ), top AS (SELECT vec_id, max(s) AS m FROM long GROUP BY vec_id)
        SELECT vec_id, 'class' || CAST(arg_max(i, s) AS VARCHAR) AS label_out,
               round(1 / sum(exp(s - m)), 6) AS prob_out
        FROM long JOIN top USING (vec_id) GROUP BY vec_id""",
    "xf_prompt_context": f"{_B} SELECT id, {_CONTEXT} AS prompt FROM entries",
    "xf_prompt_details": f"""{_B}
        SELECT id, CASE WHEN quality > 0 THEN {_details("text", "word || ' and so on'")}
                   ELSE {_CONTEXT} END || chr(10) || 'Respond with label only' AS prompt
        FROM entries""",
    "xf_prompt_few_shot": f"""{_B},
        shown AS (SELECT label, min(word) AS word FROM firsts GROUP BY label),
        head AS (
            SELECT 'Using the following LIWC 2015 labels for the following words as example:' || chr(10)
                   || string_agg('"' || word || '" labeled as "' || label || '"' || chr(10), ''
                                 ORDER BY word, label) AS head FROM shown
        )
        SELECT id, head || {_details("text", "lang")} AS prompt FROM entries, head""",
    "xf_prompt_few_shot_given": f"""{_B},
        shown AS (SELECT label, min(word) AS word FROM firsts GROUP BY label),
        head AS (
            SELECT 'Using the following LIWC 2015 labels for the following words as example:' || chr(10)
                   || string_agg('"' || word || '" labeled as "' || label || '"' || chr(10), ''
                                 ORDER BY label DESC) AS head FROM shown
        )
        SELECT id, head || {_details("text", "lang")} AS prompt FROM entries, head""",
    "xf_answer_labels": f"""
        WITH names(label, i) AS (VALUES {_ANSWER_VALUES}),
        hits AS (
            SELECT conv_id, turn, label, i, instr(lower(text), label) AS place
            FROM conversations, names WHERE instr(lower(text), label) > 0
        ),
        found AS (
            SELECT conv_id, turn, string_agg(label, '|' ORDER BY place, i) AS labels,
                   first(label ORDER BY place, i) AS label
            FROM hits GROUP BY conv_id, turn
        )
        SELECT conv_id, turn, coalesce(labels, '') AS labels, label
        FROM conversations LEFT JOIN found USING (conv_id, turn)""",
    # --- filters
    "flt_labelled": f"{_B} SELECT id, word FROM labelled",
    "flt_quality": f"""{_B}
        SELECT id, word, quality FROM (
            SELECT *, row_number() OVER (PARTITION BY dictionary, word ORDER BY id) AS rn FROM entries
        ) WHERE rn <= 3 AND quality >= 2""",
    "flt_confidence": f"{_B} SELECT id, label_out FROM scored WHERE prob_out >= 0.8",
    "flt_unlabelled_positive": f"""{_B}
        SELECT id, word, quality FROM entries
        WHERE word NOT IN (SELECT word FROM lexicon) AND quality > 0""",
    "get_definition": f"{_B} SELECT id, word, text, quality FROM entries WHERE word = 'the'",
    # --- joins
    "join_label_exact": f"""{_B}
        SELECT id, word, coalesce(labels, '') AS labels FROM entries LEFT JOIN lists USING (word)""",
    "join_label_prefix": f"""{_B},
        stems AS (SELECT rtrim(pattern, '*') AS stem, is_prefix, label FROM patterns),
        matched AS (
            SELECT word, label FROM (SELECT DISTINCT word FROM entries) w JOIN stems
              ON starts_with(word, stem) AND (is_prefix OR word = stem)
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY is_prefix, length(stem) DESC) = 1
        )
        SELECT id, word, coalesce(label, '') AS labels FROM entries LEFT JOIN matched USING (word)""",
    "join_label_rollup": _with(_BASE, _ROLLUP.format(used="'european', 'germanic'"))
    + " SELECT word, labels FROM rolled_lists",
    "join_lookup_mapped": _with(_BASE, _ROLLUP.format(used="'germanic', 'es'"))
    + " SELECT id, word, coalesce(labels, '') AS labels FROM entries LEFT JOIN rolled_lists USING (word)",
    "anti_exclusions": f"""{_B}
        SELECT id, word FROM entries
        WHERE word NOT IN (SELECT term FROM frequent) 
          AND word NOT IN ('and', 'of', 'der', 'les', 'con', 'was')""",
    "semi_test_entries": f"""{_D}
        SELECT dictionary, id, word, label FROM valid WHERE word IN (SELECT word FROM picked)""",
    "anti_train_entries": f"{_D} SELECT dictionary, id, word, label FROM train",
    "join_bucketed": f"""{_D}
        SELECT dictionary, id, word, label, labels, CASE WHEN word IN (SELECT word FROM picked) THEN 'test' ELSE 'train' END AS split
        FROM valid JOIN lists USING (word)""",
    "anti_new_terms": f"""{_B}
        SELECT id, word, label_out FROM scored WHERE word NOT IN (SELECT word FROM lexicon)""",
    "join_expanded_lookup": _with(_BASE, _grown("scored", "grown", "").format(threshold=0))
    + """
        SELECT id, word, coalesce(grown.label, labels, '') AS labels
        FROM entries LEFT JOIN grown ON grown.term = word LEFT JOIN lists USING (word)""",
    "join_answer_cache": f"""{_B}
        SELECT 'hit' AS kind, id, word AS prompt, label AS answer FROM labelled
        UNION ALL
        SELECT DISTINCT 'ask', CAST(NULL AS BIGINT), word, CAST(NULL AS VARCHAR) FROM entries
        WHERE word NOT IN (SELECT word FROM firsts)""",
    # --- aggregations
    "agg_label_counts": f"{_B} SELECT dictionary, label, count(*) AS n FROM labelled GROUP BY 1, 2",
    "agg_label_distribution": f"""{_B}
        SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM labelled GROUP BY label""",
    "agg_average_size": f"""{_B}
        SELECT count(*) / count(DISTINCT dictionary) AS average_size FROM labelled""",
    "agg_label_set": f"{_B} SELECT DISTINCT label FROM lexicon",
    "agg_test_quota": _with(_BASE, _split("labelled", "42", "lab_"))
    + " SELECT label, n, round(share, 6) AS share, quota FROM lab_quotas",
    "agg_confusion": f"{_B} SELECT label, label_out, count(*) AS n FROM scored GROUP BY 1, 2",
    "agg_accuracy": f"""{_B}
        SELECT round(avg(CASE WHEN label = label_out THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored""",
    "agg_class_report": _with(_BASE, _report("scored", "VALUES ('it'), ('en')", "report"))
    + _report_rows("report"),
    "agg_macro_f1": _with(_BASE, _report("scored", "SELECT label FROM scored", "report"))
    + " SELECT round(avg(f1), 6) AS macro_f1 FROM report",
    "agg_precision_at": f"""{_B}
        SELECT round(count(*) FILTER (prob_out >= 0.8 AND label = label_out)
                     / count(*) FILTER (prob_out >= 0.8), 6) AS precision,
               round(count(*) FILTER (prob_out >= 0.8) / count(*), 6) AS coverage
        FROM scored""",
    "agg_threshold_curve": f"""{_B},
        points AS (SELECT unnest(range(0, 101)) AS t)
        SELECT round(t * CAST(0.01 AS DOUBLE), 2) AS threshold,
               round(coalesce(count(s.id) FILTER (s.label = s.label_out) / nullif(count(s.id), 0), 0), 6) AS precision,
               round(count(s.id) / (SELECT count(*) FROM scored), 6) AS coverage
        FROM points LEFT JOIN scored s ON s.prob_out >= t * CAST(0.01 AS DOUBLE)
        GROUP BY t""",
    "agg_count_curve": f"""{_B},
        points AS (SELECT dictionary, unnest(range(0, 101)) AS t FROM (SELECT DISTINCT dictionary FROM scored))
        SELECT p.dictionary, round(t * CAST(0.01 AS DOUBLE), 2) AS threshold, count(s.id) AS n
        FROM points p LEFT JOIN scored s
          ON s.dictionary = p.dictionary AND s.prob_out >= t * CAST(0.01 AS DOUBLE)
        GROUP BY p.dictionary, t""",
    "agg_value_counts": f"{_B} SELECT label_out AS value, count(*) AS n FROM scored GROUP BY 1",
    # --- windows and sorts
    "win_top_n_per_word": f"""{_B}
        SELECT dictionary, id, word FROM entries
        QUALIFY row_number() OVER (PARTITION BY dictionary, word ORDER BY id) <= 4""",
    "win_top_n_by_quality": f"""{_B}
        SELECT dictionary, id, word FROM entries
        QUALIFY row_number() OVER (PARTITION BY dictionary, word ORDER BY quality DESC, id) <= 4""",
    "win_best_quality": f"""{_B}
        SELECT dictionary, id, word, quality FROM entries
        QUALIFY row_number() OVER (PARTITION BY dictionary, word
            ORDER BY quality DESC, md5('0:' || CAST(id AS VARCHAR)), id) = 1""",
    "win_best_confidence": f"""{_B}
        SELECT dictionary, id, word, label_out FROM scored
        QUALIFY row_number() OVER (PARTITION BY dictionary, word ORDER BY prob_out DESC, id) = 1""",
    "win_last_wins": f"""{_B}
        SELECT dictionary, word, arg_max(lang, id) AS label_out FROM entries GROUP BY 1, 2""",
    "win_pick_terms": _with(_BASE, _split("labelled", _SHARE, "lab_"))
    + " SELECT word, label FROM lab_picked",
    "sort_seeded_shuffle": f"""{_B}
        SELECT id, word, md5('0:' || CAST(id AS VARCHAR)) AS sort_key FROM entries ORDER BY sort_key""",
    "sort_permuted": _with(_BASE, _PERMUTED) + " SELECT id, word, x AS place FROM walked WHERE x < n",
    "sink_shuffled": _with(_BASE, _PERMUTED)
    + """ SELECT count(*) AS n, min(x) AS first_place, max(x) AS last_place, sum(id)::BIGINT AS ids
        FROM walked WHERE x < n GROUP BY x // 1000""",
    "sort_by_confidence": f"""{_B}
        SELECT id, word, round(prob_out, 6) AS prob_out FROM scored ORDER BY scored.prob_out DESC, id""",
    # --- sets
    "set_common_terms": _with(_BASE, _split("labelled", "0", "lab_")) + " SELECT word, label FROM lab_common",
    "set_dataset_all": f"{_D} SELECT dictionary, id, split FROM dataset",
    "set_label_union": f"""{_D}
        SELECT label, bool_or(split = 'train') AS in_train, bool_or(split = 'test') AS in_test
        FROM dataset GROUP BY label""",
    # --- models
    "ml_label_index": f"{_I} SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM label_index",
    "ml_encode_text": _with(_BASE, _PIECES)
    + """
        SELECT dictionary, id, array_to_string(list_concat(ids, list_transform(range(24 - len(ids)), lambda i: 0)), ' ') AS input_ids,
               array_to_string(list_transform(range(24), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask
        FROM encoded""",
    "ml_train_softmax": _with(_BASE, _SETS, _LABEL_INDEX, _PIECES, _softmax())
    + f" SELECT dictionary, CAST(piece AS BIGINT) AS piece, label, round(w, 6) AS w FROM after{EPOCHS}",
    "ml_apply_softmax": _with(_BASE, _SETS, _LABEL_INDEX, _PIECES, _softmax(), _SOFTMAX_SCORED)
    + """
        SELECT p.dictionary, p.id, word, label_out, round(prob_out, 4) AS prob_out FROM all_probs p
        JOIN entries e ON e.dictionary = p.dictionary AND e.id = p.id
        QUALIFY row_number() OVER (PARTITION BY p.dictionary, p.id ORDER BY p.prob_out DESC, label_out) = 1""",
    "ml_token_counts": rf"""{_B}
        SELECT dictionary, id, token, count(*) AS n FROM (
            SELECT dictionary, id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token FROM entries
        ) GROUP BY 1, 2, 3""",
    "ml_train": _M + _MODEL_ROWS,
    "ml_apply": _with(_BASE, _SETS, _LABEL_INDEX, _MODEL, _ALL_SCORED)
    + " SELECT dictionary, id, word, label_out, round(prob_out, 4) AS prob_out FROM all_scored",
    "ml_eval": _with(
        _BASE, _SETS, _LABEL_INDEX, _MODEL, _TEST_SCORED,
        _report("test_scored", "SELECT DISTINCT dictionary, label FROM train", "report", "dictionary"),
    )
    + _report_rows("report", "dictionary"),
    "ml_persist": _M + _MODEL_ROWS,
    "ml_apply_function": f"""{_B}
        SELECT id, ['de', 'en', 'es', 'fr'][length(text) % 4 + 1] AS label_out,
               round(1.0 / (1 + length(text) % 8), 6) AS prob_out FROM entries""",
    "ml_apply_predictor": f"""{_B}
        SELECT id, ['de', 'en', 'es', 'fr'][(length(text) + id) % 4 + 1] AS label_out,
               round(1.0 / (1 + length(text) % 8), 6) AS prob_out FROM entries""",
    # --- jobs
    "agg_run_summary": _with(_BASE, _SETS, _LABEL_INDEX, _MODEL, _SUMMARY) + " SELECT * FROM summary",
    "job_valid_entries": f"{_D} SELECT dictionary, id, word, text, quality, label FROM valid",
    "job_valid_entries_stream": f"{_D} SELECT dictionary, id, word, text, quality, label FROM valid",
    "job_valid_entries_mixed": f"""{_D} SELECT dictionary, id, word, text, quality, label FROM valid
        WHERE dictionary <> 'd1'
        UNION ALL SELECT dictionary, id, word, text, NULL, label FROM allowed WHERE dictionary = 'd1'""",
    "job_split_dataset": f"{_D} SELECT dictionary, id, word, quality, label, split FROM dataset",
    "job_expand_lexicon": _with(_BASE, _grown("scored", "grown").format(threshold=0.8))
    + " SELECT dictionary, term, label, round(prob_out, 6) AS prob_out FROM grown",
    "job_ask_labels": rf"""{_B},
        asked AS (
            SELECT conv_id, turn, lower(regexp_extract(text, '(\p{{L}}+)', 1)) AS word, text
            FROM conversations WHERE role = 'user' AND regexp_extract(text, '(\p{{L}}+)', 1) <> ''
        ),
        prompts AS (
            SELECT conv_id, turn, word,
                'In the following context: ' || chr(10) || '"' || text || '", ' || chr(10)
                || 'which label should be assigned to the word "' || word || '" from the following '
                || '"speech act" labels: statement, question, request?' AS prompt
            FROM asked
        ),
        answered AS (
            SELECT conv_id, turn, word,
                   ['statement', 'question', 'request'][length(prompt) % 3 + 1] AS label_out FROM prompts
        )
        SELECT conv_id, turn, word, 'I would say: ' || label_out || '.' AS answer, label_out FROM answered""",
    "job_experiment": _with(
        _BASE, _SETS, _LABEL_INDEX, _MODEL, _SUMMARY, _grown("all_scored", "grown").format(threshold=0.8)
    )
    + """
        SELECT summary.*, expanded FROM summary
        JOIN (SELECT dictionary, count(*) AS expanded FROM grown GROUP BY 1) USING (dictionary)""",
    "job_expanded_terms": _with(
        _BASE, _SETS, _LABEL_INDEX, _MODEL, _ALL_SCORED, _grown("all_scored", "grown").format(threshold=0.8)
    )
    + " SELECT dictionary, term, label FROM grown",
}
