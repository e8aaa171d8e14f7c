"""What SQL can restate of operators 1, 6 and 8: their fixed columns, with DuckDB's way to the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.pii import op8_bootstrapped_contexts
from keyloom.llm.quality import op1_ngram_logistic
from keyloom.llm.url_filter import RULES, op6_ngram_logistic

TEXT_STATISTICS_SQL = r"""with w as (select doc_id, unnest(x) as word, generate_subscripts(x, 1) as i from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as x from documents where text is not null)),
s as (select doc_id, i, count(*) over f as n, list(word) over f as win from w window f as (partition by doc_id order by i rows between current row and 7 following)),
r as (select doc_id, i, n = 8 and count(*) over (partition by doc_id, n, win) > 1 as rep from s),
m as (select doc_id, bool_or(rep) over (partition by doc_id order by i rows between 7 preceding and current row) as marked from r),
k as (select doc_id, count(*) filter (marked) as n_repeat_words from m group by 1),
c as (select doc_id, count(*) as n_words, sum(length(word))::bigint as word_chars from w group by 1),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
a as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from documents left join c using (doc_id) left join l using (doc_id) left join k using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from a"""


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base verdict of op1."""
    return op1_ngram_logistic(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
URL_RULES_SQL = f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
select page_id, host, path, case {_fits} end as rule from h"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op6."""
    return op6_ngram_logistic(spark, sf_dir).select("page_id", "host", "path", "rule")


_digits = "regexp_replace(m, '[^0-9]', '', 'g')"
_twice = f"2 * substr(reverse({_digits}), k, 1)::int"
_luhn = f"list_sum(list_transform(range(1, length({_digits}) + 1), lambda k: case when k % 2 = 1 then substr(reverse({_digits}), k, 1)::int when {_twice} > 9 then {_twice} - 9 else {_twice} end)) % 10 = 0"
PERSONAL_DATA_SQL = rf"""with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(try_cast(p as hugeint) <= 255, false))))) as n_ip,
len(list_filter(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda m: case when length({_digits}) between 13 and 19 then {_luhn} else false end)) as n_card,
len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({_digits}) between 9 and 15)) as n_phone from t"""


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8's base patterns."""
    return op8_bootstrapped_contexts(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {"text_statistics": text_statistics, "url_rules": url_rules, "personal_data": personal_data}
ORACLE_SQL = {"text_statistics": TEXT_STATISTICS_SQL, "url_rules": URL_RULES_SQL, "personal_data": PERSONAL_DATA_SQL}
