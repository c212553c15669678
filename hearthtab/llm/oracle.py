"""DuckDB SQL for the training-data queries that SQL can express, over the whole tables."""

from __future__ import annotations

from hearthtab.llm import quality, secrets


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql(rules=secrets.RULES, base=secrets.BASE_RULES) -> str:
    """Spans of every rule by splitting at its matches and adding up lengths."""
    parts = "\nUNION ALL\n".join(
        f"""SELECT doc_id, {rank} AS rank, {_literal(r.kind)} AS kind, {r.least} AS least,
  regexp_extract_all(t, {_literal(r.pattern)}, 0) AS m,
  regexp_extract_all(t, {_literal(r.pattern)}, {r.group}) AS v,
  string_split_regex(t, {_literal(r.pattern)}) AS g
FROM texts WHERE regexp_matches(t, {_literal(r.hint)})"""
        for rank, r in enumerate(rules)
    )
    counts = ", ".join(
        f"coalesce(count(*) FILTER (kind = {_literal(r.kind)}), 0) AS n_{r.kind}" for r in base
    )
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({parts}),
each_match AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, rank, kind, start, start + length(m[i]) AS stop
  FROM (
    SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM each_match
  ) WHERE length(v[i]) >= least
),
by_doc AS (
  SELECT doc_id, {counts},
    string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < {len(base)}) AS base,
    string_agg({text}, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


def quality_sql() -> str:
    """Counts, distances and verdict of every document."""
    space = r"[\x20\x09-\x0D]"
    classes = {
        "digit": "[0-9]",
        "upper": "[A-Z]",
        "beyond_ascii": r"[^\x00-\x7F]",
        # Printable ASCII that is no letter, digit or symbol of the count.
        "mark": r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]""",
    }
    count = lambda rx: f"length(t) - length(regexp_replace(t, {_literal(rx)}, '', 'g'))"
    lists = " ".join(
        f"WHEN {_literal(lang)} THEN [{', '.join(map(_literal, words))}]"
        for lang, words in quality.COMMON_WORDS.items()
    )
    n, last = quality.REPEAT_WINDOW, quality.REPEAT_WINDOW - 1
    jsd = lambda p, q: (
        f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        "(CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + "
        "(CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0))"
    )
    share = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1))"
    sums = lambda c, size: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(size)) + "]"
    usage = ", ".join(
        f"len(list_filter(w, lambda x: x = c[{k + 1}]))" for k in range(12)
    )
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t
  FROM documents
),
words AS (
  SELECT *, list_filter(string_split_regex(t, {_literal(space + '+')}), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CASE lang {lists} ELSE CAST([] AS VARCHAR[]) END AS c
  FROM texts
),
places AS (
  SELECT r, i, array_to_string(w[i:i + {last}], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - {last - 1})) AS i FROM words WHERE len(w) >= {n})
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM places) WHERE k > 1),
covered AS (
  SELECT r, CAST(sum(least({n}, coalesce(after - i, {n}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r
),
counted AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(t) AS n_chars,
    length(array_to_string(w, '')) AS word_chars,
    {count(r'[#*$%&|<>]')} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    {', '.join(f"{count(rx)} AS c_{name}" for name, rx in classes.items())},
    CASE WHEN len(c) = 12 THEN [{usage}] ELSE [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] END AS used
  FROM words LEFT JOIN covered USING (r)
),
shaped AS (
  SELECT *,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_transform([n_chars - word_chars, n_symbols, c_digit, c_upper, c_beyond_ascii, c_mark,
      word_chars - n_symbols - c_digit - c_upper - c_beyond_ascii - c_mark], lambda x: x::DOUBLE) AS classes,
    list_transform(list_append(used, n_words - list_sum(used)), lambda x: x::DOUBLE) AS usage
  FROM counted
),
reference AS (
  SELECT lang, {sums('classes', 7)} AS all_classes, {sums('usage', 13)} AS all_usage
  FROM shaped WHERE NOT base_failed GROUP BY lang
),
judged AS (
  SELECT *,
    CASE WHEN n_chars >= 400 AND n_words >= 80
      THEN {jsd(share('classes'), share('all_classes'))} END AS class_distance,
    all_usage[13] / list_sum(all_usage) AS rest,
    CASE WHEN n_chars >= 400 AND n_words >= 80
        AND lang IN ({', '.join(map(_literal, quality.COMMON_WORDS))})
      THEN {jsd(share('usage'), share('all_usage'))} END AS word_distance
  FROM shaped LEFT JOIN reference USING (lang)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance, base_failed,
  -- A document of other words alone shares only the last bin with its language.
  NOT base_failed AND coalesce(class_distance, 0) <= 0.3::DOUBLE
    AND (coalesce(word_distance, 0) <= 0.95::DOUBLE
      * sqrt(((1 - log2(1 + rest)) + (1 - rest) + rest * log2(2 * rest / (1 + rest))) / 2) OR rest = 1) IS NOT FALSE AS kept
FROM judged
"""


def trie_sql() -> str:
    """Every member's prefixes as text; subtree figures by way of the smallest member's path."""
    # CRC-32 bit by bit: 4294967295 is all ones, 3988292384 the reversed polynomial.
    bit = "xor(c >> 1, (c & 1) * 3988292384)"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {bit})"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv AS VARCHAR), ''), "
        f"lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    )
    return f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS spot
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv, conv - ((conv % 5) + 5) % 5 AS base, {crc} % 9 AS h
  FROM (SELECT DISTINCT conv FROM turns)
),
rebuilt AS (
  SELECT c.conv, t.spot, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.spot <= c.h
  UNION ALL
  SELECT c.conv, t.spot + 8, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.spot > c.h
),
members AS (
  SELECT conv, row_number() OVER w AS depth, strlen(text) AS n_bytes,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv ORDER BY spot)
  UNION ALL
  SELECT conv, 0, 0, '' FROM convs
),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(n_bytes) AS own
  FROM members GROUP BY node
),
children AS (
  SELECT left(node, greatest(length(node) - 64, 0)) AS node, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY 1
),
figures AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)
),
subtree AS (
  SELECT m.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.own) AS saved
  FROM figures f JOIN members m ON m.conv = f.conv_id AND m.depth <= f.depth GROUP BY m.node
),
ends AS (
  SELECT node, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS convs
  FROM (SELECT conv, arg_max(node, depth) AS node FROM members GROUP BY conv) GROUP BY node
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(convs, '')) AS ends_sha256
FROM figures f JOIN subtree USING (node) LEFT JOIN ends USING (node)
LEFT JOIN figures p ON f.depth > 0 AND p.node = left(f.node, length(f.node) - 64)
"""
