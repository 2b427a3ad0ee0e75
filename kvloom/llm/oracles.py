"""DuckDB SQL for the queries of this subpackage that SQL can express. Rules and limits come from the operators."""

from __future__ import annotations

from kvloom.llm import linkgraph, repetition, substrings

WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: Each document's words, and each word with its place.
WORDS = f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS ws FROM documents),
words AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d)"""


def _grams(n: int) -> str:
    """Of each word whether it is in an n-gram that its document holds twice (twice), or that it has held before (later)."""
    return f"""g{n} AS (SELECT x.r, x.i, x.word, CASE WHEN x.i <= x.n - {n - 1} THEN array_to_string(d.ws[x.i:x.i + {n - 1}], ' ') END AS g FROM words x JOIN d USING (r)),
f{n} AS (SELECT r, i, word, CAST(g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS INT) AS twice,
  CAST(g IS NOT NULL AND row_number() OVER (PARTITION BY r, g ORDER BY i) > 1 AS INT) AS later FROM g{n}),
c{n} AS (SELECT r, word, max(twice) OVER u AS twice, max(later) OVER u AS later FROM f{n} WINDOW u AS (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
s{n} AS (SELECT r, CAST(sum(twice) AS BIGINT) AS twice, CAST(sum(later * length(word)) AS BIGINT) AS chars FROM c{n} GROUP BY r)"""


def repetition_sql() -> str:
    sizes = sorted({3, *repetition.NGRAM_LIMITS})
    chars = "".join(f", coalesce(s{n}.chars, 0) AS dup_{n}gram_chars" for n in repetition.NGRAM_LIMITS)
    joins = "".join(f" LEFT JOIN s{n} ON s{n}.r = d.r" for n in sizes)
    share = lambda limit: f"{limit}::DOUBLE * greatest(word_chars, 1)::DOUBLE"
    good = " AND ".join([f"dup_line_chars::DOUBLE <= {share(repetition.LINE_LIMIT)}", *(f"dup_{n}gram_chars::DOUBLE <= {share(limit)}" for n, limit in repetition.NGRAM_LIMITS.items())])
    return f"""WITH {WORDS}, {', '.join(map(_grams, sizes))},
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
marked AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS later FROM lines WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT r, count_if(later) AS n, sum(CASE WHEN later THEN length(regexp_replace(line, '{SPACE}+', '', 'g')) ELSE 0 END) AS chars FROM marked GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(s3.twice, 0) AS n_repeat_words,
  CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars{chars} FROM d LEFT JOIN dup ON dup.r = d.r{joins}),
b AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {good} AS kept FROM b"""


def substrings_sql() -> str:
    n = substrings.WINDOW
    return f"""WITH {WORDS},
w AS (SELECT x.r, x.doc_id, x.i, x.word, CASE WHEN x.i <= x.n - {n - 1} THEN md5(array_to_string(d.ws[x.i:x.i + {n - 1}], ' ')) END AS k FROM words x JOIN d USING (r)),
f AS (SELECT r, i, word, CAST(k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS INT) AS held FROM w),
c AS (SELECT r, i, word, max(held) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
s AS (SELECT r, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


def linkgraph_sql(rounds: int = 200) -> str:
    """Walks of a fixed number of rounds, which is more than any walk needs to settle that the digits shown can tell."""
    g = linkgraph
    rules = ", ".join(f"({r.allow}, '{r.host}', '{r.path}', '{r.text}')" for r in g.RULES)
    host = lambda rest: f"translate(regexp_extract({rest}, '^[^/?#]*'), '{g.UPPER}', '{g.LOWER}')"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    shown = lambda score: f"CAST(format('{{:.6e}}', coalesce({score}, 0.0)::DOUBLE) AS DOUBLE)"

    def walk(name: str, source: str, target: str, seeds: str) -> str:
        return f"""{name}_start AS (SELECT host, {seeds} / sum({seeds}) OVER ()::DOUBLE AS start FROM hosts WHERE {seeds} > 0),
{name}_steps AS (SELECT {source} AS source, {target} AS target, n / sum(n) OVER (PARTITION BY {source})::DOUBLE AS share FROM edges),
{name}_walk(i, host, score) AS (SELECT 0, host, start::DOUBLE FROM {name}_start UNION ALL
  SELECT i, host, sum(score) FROM (
    SELECT w.i + 1 AS i, unnest([s.target, w.host]) AS host, unnest([{g.DAMPING} * w.score * s.share, 0.0])::DOUBLE AS score FROM {name}_walk w JOIN {name}_steps s ON s.source = w.host WHERE w.i < {rounds}
    UNION ALL SELECT w.i + 1, w.host, CAST((1 - {g.DAMPING}) * t.start AS DOUBLE) FROM {name}_walk w JOIN {name}_start t USING (host) WHERE w.i < {rounds}) GROUP BY i, host),
{name} AS (SELECT host, score FROM {name}_walk WHERE i = {rounds})"""

    return f"""WITH RECURSIVE rules(allow, rhost, rpath, rtext) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, page_id, url, html, coalesce({host(rest)}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT r, rtext, allow, row_number() OVER (PARTITION BY r ORDER BY length(rtext) DESC, rtext) AS place FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS (SELECT p.*, fit.rtext, fit.allow FROM p LEFT JOIN fit ON fit.r = p.r AND place = 1),
hosts AS (SELECT host, sum(CASE WHEN allow THEN 1 WHEN NOT allow THEN -1 ELSE 0 END) AS balance FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT r, host AS source, unnest(regexp_extract_all(html, '{g.LINKS.replace("'", "''")}', 1)) AS link FROM p),
named AS (SELECT r, source, {host("regexp_replace(link, '^[^/]*//', '')")} AS target FROM links
  UNION SELECT r, host, translate(unnest(regexp_extract_all(html, '{g.CREDITS}', 1)), '{g.UPPER}', '{g.LOWER}') FROM p),
edges AS (SELECT source, target, count(*) AS n FROM named WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target),
{walk('trusted', 'source', 'target', 'balance')},
{walk('blocked', 'target', 'source', '(-balance)')},
scores AS (SELECT host, {shown('t.score')} AS trust, {shown('b.score')} AS distrust FROM hosts LEFT JOIN trusted t USING (host) LEFT JOIN blocked b USING (host))
SELECT page_id, host, path, rtext AS rule, CASE WHEN coalesce(allow, coalesce(distrust, 0) <= {g.RATIO} * coalesce(trust, 0)) THEN 'allow' ELSE 'block' END AS verdict,
  coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust FROM ruled LEFT JOIN scores USING (host)"""


ORACLES = {"op1_repetition": repetition_sql(), "op7_substrings": substrings_sql(), "op10_linkgraph": linkgraph_sql()}
