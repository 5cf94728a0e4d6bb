"""The queries that SQL can express, as SQL for the oracle's engine, written on their own."""

from __future__ import annotations

from shoalgraph.llm import license_scan, quality_rules
from shoalgraph.llm.sharding import OVERHEAD

DOCS = "docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def line_dedup(min_chars: int = 40) -> str:
    """A line goes from a text if it lies in a run of at least ``min_chars`` that the text of a smaller document holds too; later copies go whole.

    Runs are the shortest ones from or up to each line; what alignment finds is the same set of lines.
    """
    white = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""WITH {DOCS},
split AS MATERIALIZED (SELECT r, doc_id, text, list_transform(string_split(text, chr(10)), lambda s: trim(s, {white})) AS l, string_split(text, chr(10)) AS raw FROM docs),
firsts AS MATERIALIZED (SELECT text, min(doc_id) AS first FROM docs WHERE doc_id IS NOT NULL GROUP BY text),
own AS MATERIALIZED (SELECT DISTINCT text, first AS doc_id, list_filter(l, lambda s: s <> '') AS l FROM firsts JOIN split USING (text)),
lines AS MATERIALIZED (SELECT doc_id, k, l[k] AS s, sum(length(l[k])) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM own, unnest(range(1, len(l) + 1)) AS u(k)),
ends AS (SELECT x.doc_id, x.k AS lo, min(y.k) AS hi FROM lines x JOIN lines y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.upto + length(x.s) >= {min_chars} GROUP BY 1, 2),
starts AS (SELECT x.doc_id, max(y.k) AS lo, x.k AS hi FROM lines x JOIN lines y ON x.doc_id = y.doc_id AND y.k <= x.k AND x.upto - y.upto + length(y.s) >= {min_chars} GROUP BY x.doc_id, x.k),
runs AS MATERIALIZED (SELECT doc_id, lo, hi, array_to_string(l[lo:hi], chr(10)) AS run FROM (SELECT * FROM ends UNION SELECT * FROM starts) JOIN own USING (doc_id)),
owners AS (SELECT run, min(doc_id) AS owner FROM runs GROUP BY run),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM runs JOIN owners USING (run), unnest(range(lo, hi + 1)) AS u(k) WHERE doc_id > owner),
places AS MATERIALIZED (SELECT doc_id, list(k) AS gone FROM gone GROUP BY doc_id),
marked AS (SELECT split.*, first, gone, len(list_filter(l, lambda s: s <> '')) AS n FROM split LEFT JOIN firsts USING (text) LEFT JOIN places ON places.doc_id = split.doc_id AND first = split.doc_id),
numbered AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] = '' THEN 0 ELSE len(list_filter(l[1:i], lambda s: s <> '')) END) AS nth FROM marked)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(CASE WHEN n > 0 AND first < doc_id THEN n ELSE coalesce(len(gone), 0) END AS BIGINT) AS n_removed,
  CASE WHEN n > 0 AND first < doc_id THEN '' WHEN gone IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, nth[i])), lambda i: raw[i]), chr(10)) END AS text FROM numbered"""


def near_duplicates(least: float = 0.8, size: int = 5) -> str:
    """Exact multiset overlap of all pairs of texts that share a shingle, and what links connect."""
    return f"""WITH RECURSIVE {DOCS},
texts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) AS t, text, {WORDS.format("text")} AS w FROM (SELECT DISTINCT text FROM docs)),
shingles AS (SELECT t, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM texts, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) AS u(i) WHERE len(w) > 0),
items AS MATERIALIZED (SELECT t, s, row_number() OVER (PARTITION BY t, s) AS nth FROM shingles),
sizes AS MATERIALIZED (SELECT t, count(*) AS n FROM items GROUP BY t),
pairs AS (SELECT x.t AS a, y.t AS b, count(*) AS c FROM items x JOIN items y ON x.s = y.s AND x.nth = y.nth AND x.t < y.t GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= {least}),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(t, o) AS (SELECT t, t FROM texts UNION SELECT reach.t, steps.b FROM reach JOIN steps ON steps.a = reach.o),
first AS (SELECT text, min(doc_id) AS doc_id FROM docs GROUP BY text),
classes AS (SELECT x.text, coalesce(any_value(sizes.n), 0) AS n, min(f.doc_id) AS class_id FROM texts x JOIN reach USING (t) JOIN texts y ON y.t = reach.o JOIN first f ON f.text = y.text LEFT JOIN sizes ON sizes.t = x.t GROUP BY x.text)
SELECT doc_id, class_id, CAST(n AS BIGINT) AS n_shingles, coalesce(doc_id = class_id, false) AS kept FROM docs JOIN classes USING (text)"""


def crc32(hex_text: str) -> str:
    """CRC-32 of the bytes that a text of hexadecimal digits stands for; needs the one row of ``crc`` at hand."""
    byte = f"list_transform(range(CAST(length({hex_text}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({hex_text}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, crc.entry[1 + (xor(c, b) & 255)])), 4294967295)"


def shards(n: int = 24) -> str:
    """Oversized groups of equal texts alone, then the smallest capacity by binary search; one step is one shard of a greedy walk."""
    bits = ", ".join(f"c{k + 1} AS (SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})" for k in range(8))
    return f"""WITH RECURSIVE {DOCS},
c0 AS (SELECT n, n AS c FROM range(256) AS t(n)), {bits},
crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS entry FROM c8),
base AS MATERIALIZED (SELECT r, doc_id, text, octet_length(encode(text)) + {OVERHEAD} AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h FROM docs),
sums AS MATERIALIZED (SELECT text, {crc32("hex(encode(text))")} AS text_crc32 FROM (SELECT DISTINCT text FROM docs), crc),
groups AS MATERIALIZED (SELECT h, CAST(sum(size) AS BIGINT) AS bytes FROM base GROUP BY h),
ranked AS (SELECT h, bytes, row_number() OVER (ORDER BY bytes DESC, h) AS k, (SELECT sum(bytes) FROM groups) - coalesce(sum(bytes) OVER (ORDER BY bytes DESC, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
  FROM groups),
refused AS (SELECT coalesce(min(k), {n}) AS k FROM ranked WHERE bytes * ({n} - k + 1) < left_ OR k >= {n}),
alone AS MATERIALIZED (SELECT h, ranked.k - 1 AS shard FROM ranked, refused WHERE ranked.k < refused.k),
rest AS MATERIALIZED (SELECT h, bytes, sum(bytes) OVER (ORDER BY h) AS stop FROM groups WHERE h NOT IN (SELECT h FROM alone)),
walk AS MATERIALIZED (SELECT list(CAST(stop AS BIGINT) ORDER BY h) AS stops, CAST(max(stop) AS BIGINT) AS total, {n} - (SELECT count(*) FROM alone) AS many FROM rest),
search(step, lo, hi, mid, pos, used) AS (
  SELECT 0, total // many, total, (total // many + total) // 2, CAST(0 AS BIGINT), 1 FROM walk
  UNION ALL
  SELECT step + 1, lo2, hi2, CASE WHEN moved THEN mid ELSE (lo2 + hi2) // 2 END, CASE WHEN moved THEN next ELSE 0 END, CASE WHEN moved THEN used + 1 ELSE 1 END FROM (
    SELECT *, CASE WHEN pos + mid >= total THEN mid ELSE hi END AS hi2, CASE WHEN pos + mid < total AND used >= many THEN mid + 1 ELSE lo END AS lo2, pos + mid < total AND used < many AS moved
    FROM (SELECT search.*, walk.total, walk.many, coalesce(list_max(list_filter(walk.stops, lambda e: e <= pos + mid)), 0) AS next FROM search, walk WHERE lo < hi))),
best AS (SELECT hi AS capacity FROM search WHERE lo >= hi),
cuts(k, pos) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT k + 1, list_max(list_filter(walk.stops, lambda e: e <= pos + capacity)) FROM cuts, walk, best WHERE pos + capacity < total AND k < many),
placed AS (SELECT h, shard FROM alone UNION ALL SELECT h, (SELECT count(*) FROM alone) + (SELECT count(*) FROM cuts WHERE k > 0 AND pos <= stop - bytes) FROM rest)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), doc_id NULLS FIRST, h) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM base JOIN sums USING (text) JOIN placed USING (h)"""


def repeated_spans(length: int = 50) -> str:
    """Every string of ``length`` bytes of every text, with its smallest document."""
    return f"""WITH {DOCS},
base AS MATERIALIZED (SELECT r, doc_id, encode(text) AS x FROM docs),
pieces AS MATERIALIZED (SELECT r, doc_id, b, array_slice(x, b + 1, b + {1023 + length}) AS x FROM base, unnest(range(0, octet_length(x), 1024)) AS u(b) WHERE doc_id IS NOT NULL),
strings AS MATERIALIZED (SELECT r, doc_id, b + j AS i, array_slice(x, j + 1, j + {length}) AS s FROM pieces, unnest(range(0, octet_length(x) - {length - 1})) AS u(j)),
first AS MATERIALIZED (SELECT s, min(doc_id) AS doc_id FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS MATERIALIZED (SELECT r, i FROM strings JOIN first USING (s) WHERE strings.doc_id > first.doc_id),
spans AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 1 ELSE 0 END AS new FROM gone),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM spans),
cut AS MATERIALIZED (SELECT r, k, min(i) AS lo, max(i) + {length} AS hi FROM numbered GROUP BY r, k),
gaps AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM cut),
kept AS (SELECT r, string_agg(hex(array_slice(x, since + 1, lo)), '' ORDER BY lo) AS x, count(*) AS n FROM gaps JOIN base USING (r) GROUP BY r),
ends AS (SELECT r, max(hi) AS hi FROM cut GROUP BY r),
done AS (SELECT base.doc_id, octet_length(base.x) AS n_bytes, coalesce(kept.n, 0) AS n_spans, coalesce(kept.x, '') || hex(array_slice(base.x, coalesce(hi, 0) + 1, octet_length(base.x))) AS x
  FROM base LEFT JOIN kept USING (r) LEFT JOIN ends USING (r))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_bytes - length(x) / 2 AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM done"""


def licences() -> str:
    """All matches of all rules, resolved, with each space of a text doubled so that neighbouring matches share none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    doubled = lambda rule: " (?:" + rule.replace(" ?", "(?:@)?").replace(" ", "@").replace("@", "  ") + ") "
    every = license_scan.rules()
    rules = ", ".join(f"({quoted(label)}, {quoted(doubled(rule))}, {priority})" for label, rule, priority, _ in every)
    phrases = ", ".join(f"({quoted(phrase)}, {len(phrase.split())}, {quoted(label)})" for phrase, label in license_scan.BASE.items())
    hints = "|".join(sorted({k.strip() for _, _, _, k in every} | {p.split()[0] for p in license_scan.BASE}))
    count = "len(regexp_extract_all({}, '[^ ]+'))"
    return f"""WITH RECURSIVE {DOCS},
lowered AS (SELECT r, doc_id, translate(text, '{upper}', '{upper.lower()}') AS x FROM docs),
words AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(x, {quoted(license_scan.WORD)}) AS w FROM lowered),
rules(label, rule, p) AS (VALUES {rules}),
phrases(phrase, n, label) AS (VALUES {phrases}),
hinted AS MATERIALIZED (SELECT r, w, ' ' || array_to_string(w, '  ') || ' ' AS x FROM words WHERE regexp_matches(array_to_string(w, ' '), {quoted(hints)})),
base AS MATERIALIZED (SELECT r, i, label FROM hinted, phrases, unnest(range(1, len(w) + 1)) AS u(i) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
bases AS MATERIALIZED (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list(DISTINCT label) AS labels FROM base GROUP BY r),
hit AS MATERIALIZED (SELECT r, label, p, rule, string_split_regex(x, rule) AS gaps, regexp_extract_all(x, rule) AS found FROM hinted, rules WHERE regexp_matches(x, rule)),
part AS (SELECT r, label, p, rule, k, {count.format("gaps[k]")} AS gap, {count.format("found[k]")} AS size FROM hit, unnest(range(1, len(found) + 1)) AS u(k)),
placed AS (SELECT DISTINCT r, label, p, sum(gap + size) OVER (PARTITION BY r, rule, label, p ORDER BY k) - size AS s, sum(gap + size) OVER (PARTITION BY r, rule, label, p ORDER BY k) AS e FROM part),
outer_ AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, e DESC, p DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM placed) WHERE before IS NULL OR before < e),
ranked AS MATERIALIZED (SELECT r, s, e, p, label, row_number() OVER (PARTITION BY r ORDER BY p DESC, s) AS k FROM outer_),
greedy(r, k, kept) AS (
  SELECT r, k, [{{'s': s, 'e': e, 'p': p, 'label': label}}] FROM ranked WHERE k = 1
  UNION ALL
  SELECT d.r, d.k, CASE WHEN len(list_filter(greedy.kept, lambda x: x.s < d.e AND d.s < x.e)) > 0 THEN greedy.kept ELSE list_append(greedy.kept, {{'s': d.s, 'e': d.e, 'p': d.p, 'label': d.label}}) END
  FROM greedy JOIN ranked d ON d.r = greedy.r AND d.k = greedy.k + 1),
last AS (SELECT r, arg_max(kept, k) AS kept FROM greedy GROUP BY r),
named AS (SELECT words.r, doc_id, len(w) AS n_words, bases.n, lo, hi, coalesce(bases.labels, []) AS own, coalesce(list_transform(kept, lambda x: x.label), []) AS more, coalesce(list_max(list_transform(kept, lambda x: x.p)), 0) AS best
  FROM words LEFT JOIN bases USING (r) LEFT JOIN last USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, more))), ',') AS labels, greatest(best, CASE WHEN n > 0 THEN 40 ELSE 0 END) / CAST(100 AS DOUBLE) AS score FROM named"""


def quality(window: int = quality_rules.WINDOW, rounds: int = quality_rules.ROUNDS) -> str:
    """Counts, votes, and the same rounds of expectation-maximisation on the counts of vote patterns."""
    words = "[" + ", ".join(map(quoted, quality_rules.FUNCTION_WORDS)) + "]"
    rules = [
        ("10 * n_symbols > n", "100 * n_symbols <= n"),
        ("10 * n_capitals > 3 * chars", "10 * n_capitals <= chars"),
        ("50 * n_shouts > n", "false"),
        ("10 * n_dup_lines > 3 * lines", "false"),
        ("5 * n_repeat_words > n", "n_repeat_words = 0"),
        ("2 * chars < 5 * n OR chars > 14 * n", "2 * chars >= 7 * n AND 2 * chars <= 17 * n"),
        ("n_words < 30", "n_words >= 60"),
        ("5 * n_ended < lines", "5 * n_ended >= 4 * lines"),
        ("n_function = 0", "n_function >= 4"),
        ("5 * n_plain < 4 * n", "20 * n_plain >= 19 * n"),
    ]
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END" for bad, good in rules)
    prior = ", ".join(f"({c}, {v}, {p})" for c, ps in ((1, quality_rules.PRIOR[True]), (0, quality_rules.PRIOR[False])) for v, p in enumerate(ps))
    first = "(1 + len(list_filter(votes, lambda v: v = 2))) / CAST(2 + len(list_filter(votes, lambda v: v <> 1)) AS DOUBLE)"
    em = [f"p0 AS MATERIALIZED (SELECT votes, n, {first} AS q FROM patterns)"]
    for k in range(rounds):
        em.append(f"""m{k} AS MATERIALIZED (SELECT c, sum(n * CASE c WHEN 1 THEN q ELSE 1 - q END) + any_value(weight) AS whole FROM p{k}, kinds, total GROUP BY c)""")
        em.append(f"""l{k} AS MATERIALIZED (SELECT j, v, ln(sum(CASE WHEN c = 1 THEN x END)) - ln(sum(CASE WHEN c = 0 THEN x END)) AS odds FROM (
  SELECT cells.c, j, v, (weight * p + coalesce(sum(n * CASE cells.c WHEN 1 THEN q ELSE 1 - q END) FILTER (votes[j] = v), 0)) / any_value(whole) AS x FROM cells, total, p{k}, m{k} WHERE m{k}.c = cells.c GROUP BY cells.c, j, v, p, weight) GROUP BY j, v)""")
        em.append(f"""p{k + 1} AS MATERIALIZED (SELECT p{k}.votes, any_value(n) AS n, 1 / (1 + exp(-greatest(-700, least(700, (SELECT ln(max(whole) FILTER (c = 1)) - ln(max(whole) FILTER (c = 0)) FROM m{k}) + sum(odds))))) AS q FROM p{k}, l{k} WHERE p{k}.votes[j] = v GROUP BY p{k}.votes)""")
    return f"""WITH {DOCS},
words AS MATERIALIZED (SELECT r, doc_id, text, {WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM words, unnest(range(1, len(w) - {window - 2})) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
repeated AS MATERIALIZED (SELECT r, sum(least({window}, coalesce(after - i, {window}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r),
m AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, coalesce(repeated.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS n_capitals, len(regexp_extract_all(text, '!!')) AS n_shouts,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(l, lambda s: regexp_matches(s, {quoted(quality_rules.ENDED)}))) AS n_ended,
  len(list_intersect(w, {words})) AS n_function, len(list_filter(w, lambda x: regexp_matches(x, {quoted(quality_rules.PLAIN)}))) AS n_plain,
  greatest(len(w), 1) AS n, greatest(len(l), 1) AS lines, greatest(length(array_to_string(w, '')), 1) AS chars FROM words LEFT JOIN repeated USING (r)),
voted AS MATERIALIZED (SELECT *, [{votes}] AS votes FROM m),
patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
total AS MATERIALIZED (SELECT {quality_rules.WEIGHT} * sum(n) + 1 AS weight FROM patterns),
kinds AS (SELECT c FROM (VALUES (1), (0)) AS t(c)),
cells AS MATERIALIZED (SELECT c, j, v, p FROM (VALUES {prior}) AS t(c, v, p), range(1, {len(rules) + 1}) AS u(j)),
{", ".join(em)}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base AS base_failed, NOT base AND q >= 0.5 AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base FROM voted) JOIN p{rounds} USING (votes)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup(), "op3_minhash": near_duplicates(), "op4_sharding": shards(), "op6_license_scan": licences(), "op9_suffix_dedup": repeated_spans(), "op10_quality_rules": quality()}
