"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from veridex.llm.repetition_quality import MOST_IN_LINES, MOST_IN_NGRAMS
from veridex.llm.url_rules import LISTED, LOWER, UPPER

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quality() -> str:
    """Windows of 5 to 10 words; which words lie in repeats, and how many characters in repeats after the first."""
    excess = " OR ".join(f"coalesce(max(share) FILTER (n={n}),0)>{most}" for n, most in MOST_IN_NGRAMS.items())
    return rf"""WITH t AS (SELECT doc_id, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))),0)::BIGINT AS word_chars, (length(text)-length(regexp_replace(text,'[#*$%&|<>]','','g')))::BIGINT AS n_symbols FROM t),
l AS (SELECT doc_id, line, count(*)-1 AS more, length(regexp_replace(line,'{SPACE}+','','g')) AS chars FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS line FROM t) GROUP BY doc_id, line),
d AS (SELECT doc_id, coalesce(sum(more) FILTER (chars>0),0)::BIGINT AS n_dup_lines, coalesce(sum(more*chars),0) AS dup_chars FROM l GROUP BY doc_id),
p AS (SELECT doc_id, n, unnest(range(1,len(w)-n+2)) AS i, w FROM t, range(5,{5 + len(MOST_IN_NGRAMS)}) r(n) WHERE len(w)>=n),
g AS (SELECT doc_id, n, i, row_number() OVER x AS nth, count(*) OVER (PARTITION BY doc_id, n, win) AS times FROM (SELECT doc_id, n, i, array_to_string(w[i:i+n-1],' ') AS win FROM p) WINDOW x AS (PARTITION BY doc_id, n, win ORDER BY i)),
r AS (SELECT doc_id, count(DISTINCT i+k)::BIGINT AS n_repeat_words FROM g, range(0,5) q(k) WHERE n=5 AND times>1 GROUP BY doc_id),
a AS (SELECT DISTINCT doc_id, n, unnest(range(i,i+n)) AS pos FROM g WHERE nth>1),
s AS (SELECT a.doc_id, n, sum(length(w[pos]))::DOUBLE/any_value(word_chars) AS share FROM a JOIN t USING (doc_id) JOIN c USING (doc_id) GROUP BY a.doc_id, n),
m AS (SELECT doc_id, max(share) AS worst, {excess} AS excess FROM s GROUP BY doc_id),
o AS (SELECT c.*, n_dup_lines, coalesce(n_repeat_words,0) AS n_repeat_words, n_words<10 OR 100*coalesce(n_repeat_words,0)>20*n_words AS base_failed, coalesce(excess,FALSE) AS excess, coalesce(worst,0.0)::DOUBLE AS dup_ngram_share,
  CASE WHEN word_chars>0 THEN dup_chars::DOUBLE/word_chars ELSE 0.0::DOUBLE END AS dup_line_share FROM c JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR excess OR dup_line_share>{MOST_IN_LINES}) AS kept, dup_ngram_share, dup_line_share FROM o"""


def decontamination(window: int = 10) -> str:
    """Windows of items joined with windows of documents, of each length that items have."""
    words = f"regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'),'{WORDS}')"
    return rf"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark), d AS (SELECT doc_id, {words} AS w FROM documents),
v AS (SELECT item_id, w, least({window},len(w)) AS m FROM b WHERE len(w)>0), x AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1],' ') AS win FROM (SELECT *, unnest(range(1,len(w)-m+2)) AS i FROM v)),
y AS (SELECT doc_id, m, i, array_to_string(w[i:i+m-1],' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1,len(w)-m+2)) AS i FROM d, (SELECT DISTINCT m FROM x) WHERE len(w)>=m)),
h AS (SELECT doc_id, item_id, i, m FROM y JOIN x USING (m, win)), n AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i,i+m)) AS pos FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(len(ids),0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids,','),'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


def url_rules() -> str:
    """Listed rules. The labels of the test tables give no rule of enough confidence, so what no listed rule fits is
    allowed; mined rules themselves are tested against brute force."""
    fits = []
    for name, _ in sorted(LISTED, key=lambda r: -len(r[0])):
        domain, _, rest = name.partition("/")
        fits.append(f"WHEN (host='{domain}' OR ends_with(host,'.{domain}')) AND starts_with(path,'/{rest}') THEN '{name}'")
    blocked = ",".join(f"'{name}'" for name, what in LISTED if what == "block")
    return rf"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url,'(?s)^.*?://([^/?#]*)',1),''),'{UPPER}','{LOWER}') AS host, coalesce(regexp_extract(url,'(?s)^.*?://[^/?#]*([^?#]*)',1),'') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(fits)} END AS rule FROM u) SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def personal_data_base() -> str:
    """The formats that hold by themselves, counted by document."""
    digits = "regexp_replace({},'[^0-9]','','g')".format
    luhn = f"list_sum(list_transform(range(1,length({digits('x')})+1), lambda k: CASE WHEN k%2=0 THEN [0,2,4,6,8,1,3,5,7,9][reverse({digits('x')})[k]::INT+1] ELSE reverse({digits('x')})[k]::INT END))%10=0"
    some = lambda pattern, test: f"len(list_filter(regexp_extract_all(text,'{pattern}'), lambda x: {test}))::BIGINT"
    ip = r"len(list_filter(string_split(x,'.'), lambda y: length(ltrim(y,'0'))>3 OR right('000'||y,3)::INT>255))=0"
    return rf"""SELECT doc_id, {some(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE")} AS n_email, {some(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", ip)} AS n_ip,
{some(r"[0-9](?:[\x20-]?[0-9])+", f"length({digits('x')}) BETWEEN 16 AND 19 AND {luhn}")} AS n_card, {some(r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits('x')}) BETWEEN 8 AND 15")} AS n_phone
FROM (SELECT doc_id, coalesce(text,'') AS text FROM documents)"""
