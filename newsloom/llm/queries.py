"""The queries of the training-data operators."""

from __future__ import annotations

from newsloom.plans.instants import PUBLISHED
from newsloom.llm import encode, history, lookalike, neardup, packing, splitting, topn, truncation

QUERIES: dict = {
    "p1_found": history.p1_found,
    "p1_batches": history.p1_batches,
    "p3_found": topn.p3_found,
    "p4_found": neardup.p4_found,
    "p4_groups": neardup.p4_groups,
    "p5_found": truncation.p5_found,
    "p5_sources": truncation.p5_sources,
    "p5_limits": truncation.p5_limits,
    "p5_steps": truncation.p5_steps,
    "p6_found": splitting.p6_found,
    "p6_pieces": splitting.p6_pieces,
    "p6_rebuilt": splitting.p6_rebuilt,
    "p7_ids": encode.p7_ids,
    "p8_containers": packing.p8_containers,
    "p8_buckets": packing.p8_buckets,
    "p9_found": lookalike.p9_found,
    "p9_texts": lookalike.p9_texts,
    "p9_classes": lookalike.p9_classes,
}
_WS = r"[\t-\r \x{85}\p{Z}]"
_BREAK = r"(?:\r\n|\r|\n)"
_BARE = lambda x: rf"length(regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g'))"
ORACLES: dict = {
    "p6_found": rf"""WITH c AS (SELECT id, article_content AS t, string_split_regex(article_content, '{_BREAK}[\t\x0b\x0c \x{{85}}\p{{Z}}]*{_BREAK}{_WS}*') AS ps FROM news_cache WHERE length(article_content) > 1600),
s AS (SELECT id, t, ps, flatten(list_transform(ps, lambda p: string_split(regexp_replace(p, '([.!?]+["''”’»)\]}}]*)({_WS})', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS ss FROM c)
SELECT id, CASE WHEN list_max(list_transform(ps, lambda p: {_BARE('p')})) <= 1600 THEN 'paragraph' WHEN list_max(list_transform(ss, lambda x: {_BARE('x')})) <= 1600 THEN 'sentence'
  WHEN list_max(list_transform(string_split_regex(t, '{_WS}+'), lambda w: length(w))) <= 1600 THEN 'word' ELSE 'none' END AS boundary FROM s""",
    # every piece of every row: the pieces without their overlaps are the text, whole
    "p6_rebuilt": "SELECT id, md5(article_content) AS text_md5, true AS within, true AS repeats, true AS numbered FROM news_cache WHERE length(article_content) > 1600",
    "p3_found": f"""WITH pub AS ({PUBLISHED}) SELECT company_symbol, id FROM news_cache JOIN pub USING (id) QUALIFY row_number() OVER (PARTITION BY company_symbol
  ORDER BY coalesce(isnan(relevance_score), true), CASE WHEN NOT isnan(relevance_score) THEN relevance_score END DESC, utc_micros DESC NULLS LAST, id) <= 5""",
    # every pair of rows that shares a shingle, counted
    "p4_found": """WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(article_title, '') || ' ' || article_content), '[\\p{L}\\p{N}]+') AS ws FROM news_cache
  WHERE len(regexp_extract_all(lower(article_content), '[\\p{L}\\p{N}]+')) >= 30),
s AS (SELECT DISTINCT id, hash(ws[k], ws[k + 1], ws[k + 2]) AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n AS x ON x.id = id_a JOIN n AS y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)""",
}
