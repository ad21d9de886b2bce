"""DuckDB counterparts of queries whose SQL needs a hash that DuckDB lacks: CRC-32 as a fold over bytes."""

from __future__ import annotations


def _table() -> list[int]:
    """The 256 remainders of the reflected polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: crc32(bytes): unsigned CRC-32 of a list of byte values; table `crc` has one row.
CRC = f"crc AS (SELECT {_table()}::BIGINT[] AS t)"


def crc32(data: str) -> str:
    fold = f"list_reduce({data}, lambda a, b: xor(a >> 8, crc.t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))"
    return f"xor({fold}, CAST(4294967295 AS BIGINT))"


def letters(text: str) -> str:
    """UTF-8 bytes of a string of code points below 256."""
    return (
        f"list_transform(flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] "
        "ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)), lambda b: CAST(b AS BIGINT))"
    )


#: Lags with three equal words q apart at multiples of q (every run of three periods has them), then their stretches of equal places.
OP11_SQL = rf"""WITH {CRC},
 hashed AS (SELECT row_number() OVER () AS k, doc_id, text, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32(letters("CAST(doc_id AS VARCHAR)"))} END AS h FROM documents, crc),
 split AS (SELECT k, doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM hashed),
 spots AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a FROM split),
 docs AS (SELECT k, doc_id, n, a, CASE WHEN h % 10 = 0 THEN 1 + (n - a) // (3 + g % 8) ELSE n + 1 END AS p FROM spots),
 own AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM split),
 words AS (SELECT d.k, o.i, s.word FROM docs d JOIN own o ON o.k = d.k JOIN own s ON s.k = d.k AND s.i = CASE WHEN o.i < d.a THEN o.i ELSE d.a + (o.i - d.a) % d.p END),
 lags AS (SELECT k, n, unnest(range(1, n // 3 + 1)) AS q FROM docs WHERE n >= 24),
 probes AS (SELECT k, q, unnest(range(0, n - 2 * q, q)) AS i FROM lags),
 open AS (SELECT DISTINCT p.k, p.q FROM probes p JOIN words x ON x.k = p.k AND x.i = p.i JOIN words y ON y.k = p.k AND y.i = p.i + p.q AND y.word = x.word
   JOIN words z ON z.k = p.k AND z.i = p.i + 2 * p.q AND z.word = x.word),
 same AS (SELECT o.k, o.q, x.i, x.i - row_number() OVER (PARTITION BY o.k, o.q ORDER BY x.i) AS island FROM open o JOIN words x ON x.k = o.k
   JOIN words y ON y.k = o.k AND y.i = x.i + o.q AND y.word = x.word),
 stretches AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY k, q, island HAVING count(*) >= greatest(24 - q, 2 * q)),
 runs AS (SELECT k, start, length, min(q) AS period FROM stretches GROUP BY k, start, length),
 best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs),
 told AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY k),
 gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
 kept AS (SELECT words.k, string_agg(word, ' ' ORDER BY words.i) AS kept FROM words ANTI JOIN gone ON gone.k = words.k AND gone.i = words.i GROUP BY words.k)
 SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(t.lines, '')) AS runs_sha256,
  sha256(coalesce(kept.kept, '')) AS collapsed_sha256
 FROM docs d LEFT JOIN told t USING (k) LEFT JOIN best b ON b.k = d.k AND b.place = 1 LEFT JOIN kept ON kept.k = d.k"""

#: Words that share a pattern with one letter left open (replaced), or one that is the other without a letter.
OP12_SQL = rf"""WITH RECURSIVE {CRC},
 found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 per AS (SELECT id, run, count(*) AS n FROM found GROUP BY id, run),
 hashed AS (SELECT run, n, {crc32(letters("id || ':' || run"))} AS h FROM per, crc),
 cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
 places AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
 shorter AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS part FROM places),
 open AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS part FROM places),
 pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM open a JOIN open b ON a.part = b.part AND a.word <> b.word
   UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.part UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.part),
 ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
 forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
   FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
 chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
 ends AS (SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
 SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)"""
