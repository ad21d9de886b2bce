"""The registered queries of this subpackage and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from petriflow.llm.ann import op7_nearest_neighbours
from petriflow.llm.decontaminate import op5_decontamination
from petriflow.llm.html_extract import op3_html_extraction
from petriflow.llm.license_scan import op13_license_scan
from petriflow.llm.line_dedup import op1_line_dedup
from petriflow.llm.lm_scoring import op2_lm_scoring
from petriflow.llm.mixing import op10_mixing
from petriflow.llm.periodic_runs import op11_periodic_runs
from petriflow.llm.quality import op4_quality_classifier
from petriflow.llm.sharding import op8_sharding
from petriflow.llm.simhash import op9_simhash_near_dedup
from petriflow.llm.spelling import op12_spelling_variants
from petriflow.llm.sql import OP11_SQL, OP12_SQL
from petriflow.llm.substring_dedup import op6_substring_dedup


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_html_extraction": op3_html_extraction,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontamination": op5_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_sharding": op8_sharding,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_license_scan": op13_license_scan,
    }


#: Pairs of line sets that share a word of their prefixes, in order of the exact rarity of words, verified on the whole sets.
OP1_SQL = r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
 sets AS (SELECT doc_id, ln, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM lines),
 firsts AS (SELECT w, len(w) AS n, min((doc_id, ln)) AS spot, row_number() OVER (ORDER BY min((doc_id, ln))) AS k FROM sets WHERE len(w) > 0 GROUP BY w),
 words AS (SELECT k, n, unnest(w) AS word FROM firsts), rarity AS (SELECT word, count(*) AS df FROM words GROUP BY word),
 placed AS (SELECT k, n, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS place FROM words JOIN rarity USING (word)),
 heads AS (SELECT k, n, word FROM placed WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
 pairs AS (SELECT DISTINCT a.k AS later, b.k AS earlier FROM heads a JOIN heads b ON a.word = b.word AND b.k < a.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
 gone AS (SELECT DISTINCT later FROM pairs JOIN firsts x ON x.k = later JOIN firsts y ON y.k = earlier WHERE len(list_intersect(x.w, y.w)) * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
 kept AS (SELECT spot FROM firsts WHERE k NOT IN (SELECT later FROM gone)),
 lost AS (SELECT doc_id, ln FROM sets WHERE len(w) > 0 AND (doc_id, ln) NOT IN (SELECT spot FROM kept)),
 per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS removed FROM lost GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(per.n, 0) AS n_removed, coalesce(per.removed, '') AS removed
 FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id"""

#: Windows of 35 words that start more than once.
OP6_SQL = r"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 starts AS (SELECT doc_id, CAST(unnest(range(1, len(w) - 33)) AS BIGINT) AS i FROM docs WHERE len(w) >= 35),
 windows AS (SELECT s.doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM starts s JOIN docs USING (doc_id)),
 again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
 hit AS (SELECT doc_id, i FROM windows WHERE t IN (SELECT t FROM again)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM hit),
 per AS (SELECT doc_id, list(j) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
 words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs),
 kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j WHERE gone.j IS NULL GROUP BY words.doc_id)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(per.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM docs d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other queries fit models, draw at random, hash by functions that DuckDB lacks, or add up doubles in an order of their own; they are
    tested against brute force."""
    return {"op1_line_dedup": OP1_SQL, "op6_substring_dedup": OP6_SQL, "op11_periodic_runs": OP11_SQL, "op12_spelling_variants": OP12_SQL}
