"""Queries of text, version, similarity and diff functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake import constants as K
from vulnlake.catalog import sqltext as Q
from vulnlake.catalog.registry import query
from vulnlake.functions import diffs as D
from vulnlake.functions import minhash as M
from vulnlake.functions import similarity as SIM
from vulnlake.functions import text as X
from vulnlake.functions import urls as U
from vulnlake.functions import versions as V
from vulnlake.operators import tags as TG
from vulnlake.operators import twins as TW
from vulnlake.session import cut_lineage

def _msg():
    return F.col("message")


def _rows(d, array, name):
    return d("v_message").select("commit_id", F.explode(array).alias(name))


def _found(pattern: str, index: int, name: str, where: str = "") -> str:
    return (
        f"SELECT DISTINCT commit_id, unnest(regexp_extract_all(message, '{pattern}', {index})) AS {name}"
        f" FROM v_message {where}"
    )


@query("fun_01_cve_ids", _found(r"CVE-\d{4}-\d{4,8}", 0, "cve"))
def _(d):
    return _rows(d, X.cve_ids(_msg()), "cve")


ISSUES = _found(r"(?:#|gh-)(\d{1,6})", 1, "issue_id")


@query("fun_02_linked_issues", f"""
    SELECT m.commit_id, m.issue_id, coalesce(i.content, '') AS content FROM ({ISSUES}) m
    LEFT JOIN v_linked_issue i ON i.issue_id = m.issue_id""")
def _(d):
    ids = _rows(d, X.issue_ids(_msg()), "issue_id")
    return ids.join(d("v_linked_issue"), "issue_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


@query("fun_03_jira_keys", f"""
    SELECT * FROM ({_found("[A-Z]+-[0-9]{1,6}", 0, "ticket", "WHERE contains(repository, 'apache')")})
    WHERE NOT starts_with(ticket, 'CVE-')""")
def _(d):
    return _rows(d, X.jira_keys(F.col("repository"), _msg()), "ticket")


@query("fun_04_commit_fragments", _found(r"/commit/\w{6,40}", 0, "fragment"))
def _(d):
    return _rows(d, X.commit_fragments(_msg()), "fragment").distinct()


@query("fun_05_version_numbers", r"""
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)+)', 1)) AS version FROM documents""")
def _(d):
    return d("documents").select("doc_id", F.explode(X.version_numbers(F.col("text"))).alias("version"))


EXTENSIONS = "[" + ", ".join(f"'{e}'" for e in K.SOURCE_EXTENSIONS) + "]"
FILES = rf"""
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN w = 'Node.js' THEN []
        WHEN e <> '' AND list_contains({EXTENSIONS}, e)
             THEN [s]
        WHEN e <> '' AND NOT regexp_full_match(e, '[0-9]+') AND NOT regexp_matches(w, '\d+(?:\.\d+)+') THEN [e, s]
        WHEN regexp_matches(w, '[a-zA-Z][a-zA-Z]+[A-Z]\w*|(?:[a-zA-Z]{{2,}}[_-])+[a-zA-Z]{{2,}}') THEN [w]
        ELSE [] END) AS name
    FROM (SELECT doc_id, w, regexp_extract(w, '(?:(\w{{2,}})\.)+(\w+)', 1) AS s, regexp_extract(w, '(?:(\w{{2,}})\.)+(\w+)', 2) AS e
      FROM (SELECT doc_id, string_split_regex(regexp_replace(word, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'), '[\\/]')[-1] AS w
        FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> ''))"""


@query("fun_06_affected_names", f"SELECT * FROM ({FILES}) WHERE name <> ''")
def _(d):
    return d("documents").select("doc_id", F.explode(X.affected_files(F.col("text"))).alias("name"))


@query("fun_07_last_path_part", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def _(d):
    return d("pages").select("page_id", U.last_part(F.col("url")).alias("name"))


@query("fun_08_security_keywords", rf"""
    SELECT DISTINCT commit_id, word FROM (
      SELECT commit_id, unnest(string_split_regex(lower(message), '\s+')) AS word FROM v_message)
    WHERE list_contains({Q.KEYWORDS}, word)""")
def _(d):
    return _rows(d, X.security_keywords(_msg()), "word")


WORD_ROWS = r"""(SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents)"""


@query("fun_09_relevant_words", f"""
    WITH w AS (SELECT * FROM {WORD_ROWS} WHERE length(word) > 3),
         stop AS (SELECT word FROM w GROUP BY word HAVING count(*) * 5 > (SELECT count(*) FROM documents))
    SELECT doc_id, word FROM w WHERE word NOT IN (SELECT word FROM stop)""")
def _(d):
    from vulnlake.operators.wordlists import relevant_words

    return relevant_words(d("documents"), "doc_id", "text", longer_than=3, stop_share=0.2)


@query("fun_10_product_names", r"""
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^.!?\s] +(\p{Lu}\p{L}{2,})', 1)) AS product FROM documents""")
def _(d):
    return d("documents").select("doc_id", F.explode(X.product_names(F.col("text"))).alias("product"))


@query("fun_11_clean_words", f"SELECT doc_id, count(*) AS n FROM {WORD_ROWS} WHERE length(word) > 2 GROUP BY doc_id")
def _(d):
    cleaned = X.alphanumeric_tokens(F.col("text"), 2)
    return d("documents").select("doc_id", F.size(cleaned).cast("long").alias("n")).filter("n > 0")


@query("set_09_words_in_common", f"""
    WITH c AS (SELECT * FROM {WORD_ROWS} WHERE length(word) > 3 AND word <> 'that'),
         a AS (SELECT DISTINCT word FROM (
           SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark) WHERE length(word) > 3)
    SELECT doc_id, word FROM c JOIN a USING (word)""")
def _(d):
    from vulnlake.operators.wordlists import words_in_common

    return words_in_common(d("documents"), "doc_id", "text", d("benchmark"), "text", exclude="that")


TOKENS = r"""(SELECT page_id, list_filter(string_split_regex(lower(regexp_replace(p, '([A-Z])', ' \1', 'g')), '[\W_]+'), lambda x: x <> '') AS tokens
  FROM (SELECT page_id, url AS p FROM pages))"""


@query("fun_12_identifier_tokens", f"SELECT page_id, unnest(tokens) AS token FROM {TOKENS}")
def _(d):
    return d("pages").select("page_id", F.explode(X.name_tokens(F.col("url"))).alias("token"))


@query("fun_13_set_similarities", rf"""
    SELECT page_id, round(i / u, 9) AS jaccard, round(2.0 * i / (n + m), 9) AS sorensen_dice,
           round(i / sqrt(n * m), 9) AS otsuka_ochiai
    FROM (SELECT page_id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u,
                 len(list_distinct(a)) AS n, len(list_distinct(b)) AS m
          FROM (SELECT page_id, tokens AS a, list_filter(string_split_regex(lower(regexp_replace(
                  split_part(url, '/', 3) || split_part(url, '/', 4), '([A-Z])', ' \1', 'g')), '[\W_]+'), lambda x: x <> '') AS b
                FROM {TOKENS} JOIN pages USING (page_id)))""")
def _(d):
    a = X.name_tokens(F.col("url"))
    b = X.name_tokens(F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.split_part("url", F.lit("/"), F.lit(4))))
    return d("pages").select("page_id", a.alias("a"), b.alias("b")).select(
        "page_id", F.round(SIM.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"),
        F.round(SIM.sorensen_dice(F.col("a"), F.col("b")), 9).alias("sorensen_dice"),
        F.round(SIM.otsuka_ochiai(F.col("a"), F.col("b")), 9).alias("otsuka_ochiai"))


def _name_tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({text}, '([A-Z])', ' \1', 'g')), '[\W_]+'), lambda x: x <> '')"


# every token of a pair becomes one character; the table of the distance with swaps is filled row by row
CLOSE_PATHS = rf"""
    lists AS (SELECT DISTINCT p.url AS path, l.url AS term, {_name_tokens('p.url')} AS a, {_name_tokens('l.url')} AS b
              FROM v_registry_url p CROSS JOIN v_git_url l),
    chars AS (SELECT *, list_distinct(list_concat(a, b)) AS bag FROM lists WHERE abs(len(a) - len(b)) <= 3),
    lev AS (SELECT path, term, a, b, levenshtein(
              list_aggregate(list_transform(a, lambda t: chr((33 + list_position(bag, t))::INT)), 'string_agg', ''),
              list_aggregate(list_transform(b, lambda t: chr((33 + list_position(bag, t))::INT)), 'string_agg', '')) AS d FROM chars),
    close AS (SELECT * FROM lev WHERE d <= 3),
    osa(path, term, a, b, d, i, above, before) AS (
      SELECT path, term, a, b, d, 0, range(len(b) + 1), []::BIGINT[] FROM close
      UNION ALL
      SELECT path, term, a, b, d, i + 1,
        list_transform(range(len(b) + 1), lambda j: j + list_min(list_transform(step[1:j + 1], lambda v, k: v - (k - 1)))), above
      FROM (SELECT *, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE
              least(above[j + 1] + 1, above[j] + (a[i + 1] <> b[j])::INT,
                    CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN before[j - 1] + (a[i + 1] <> b[j])::INT ELSE 1000000 END) END) AS step
            FROM osa WHERE i < len(a)))"""


@query("fun_16_path_similarities", f"""
    WITH RECURSIVE {CLOSE_PATHS},
    done AS (SELECT path, term, a, b, d AS lev, above[len(b) + 1] AS dam FROM osa WHERE i = len(a)),
    measured AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, len(list_distinct(a)) AS n,
                        len(list_distinct(b)) AS m, max(lev) OVER (PARTITION BY path) AS wl, max(dam) OVER (PARTITION BY path) AS wd FROM done)
    SELECT path, term, round(i / u, 9) AS jaccard, round(2.0 * i / (n + m), 9) AS sorensen_dice, round(i / sqrt(n * m), 9) AS otsuka_ochiai,
           lev::INT AS levenshtein, dam::INT AS damerau_levenshtein, abs(len(a) - len(b))::INT AS length_diff,
           CASE WHEN wl > 0 THEN round(1 - lev / wl, 9) END AS inverted_levenshtein,
           CASE WHEN wd > 0 THEN round(1 - dam / wd, 9) END AS inverted_damerau_levenshtein FROM measured""")
def _(d):
    paths = d("v_registry_url").select(F.col("url").alias("left_id")).distinct().withColumn("tokens", X.name_tokens(F.col("left_id")))
    terms = d("v_git_url").select(F.col("url").alias("right_id")).distinct().withColumn("tokens", X.name_tokens(F.col("right_id")))
    pairs = SIM.close_token_lists(paths, terms, 3).select(F.col("left_id").alias("path"), F.col("right_id").alias("term"))
    measured = SIM.path_similarities(pairs, "path", "path", "term")
    rounded = ["jaccard", "sorensen_dice", "otsuka_ochiai", "inverted_levenshtein", "inverted_damerau_levenshtein"]
    return measured.select("path", "term", "levenshtein", "damerau_levenshtein", "length_diff", *[F.round(c, 9).alias(c) for c in rounded])


def _permutations(n: int) -> str:
    return ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(map(M.permutation, range(n))))


HASHES = rf"""(SELECT DISTINCT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {M.PRIME} AS h
  FROM (SELECT doc_id, unnest(string_split_regex(message, '\s+')) AS t FROM v_message) WHERE t <> '')"""


def band_sql() -> str:
    bands, rows = M.best_bands()
    return f"""(SELECT doc_id, md5(cast(i // {rows} AS varchar) || ':' || string_agg(cast(m AS varchar), ',' ORDER BY i)) AS band_key
      FROM (SELECT doc_id, i, min((a * h + b) % {M.PRIME}) AS m
            FROM {HASHES} CROSS JOIN (VALUES {_permutations(bands * rows)}) p(i, a, b) GROUP BY doc_id, i)
      GROUP BY doc_id, i // {rows})"""


def _band_rows(d):
    return TW.band_rows(d("v_message"), [], "doc_id", "message")


@query("fun_17_band_keys", f"SELECT doc_id, band_key FROM {band_sql()}")
def _(d):
    return _band_rows(d)


@query("joi_21_commits_with_twins", f"""
    WITH b AS ({band_sql()}), s AS (SELECT band_key FROM b GROUP BY band_key HAVING count(*) > 1)
    SELECT DISTINCT doc_id FROM b WHERE band_key IN (SELECT band_key FROM s)""")
def _(d):
    return TW.with_twins(_band_rows(d), [], "doc_id")


@query("joi_21_twin_groups")
def _(d):
    return TW.twin_groups(_band_rows(d), [], "doc_id")


@query("set_08_commits_without_twins", f"""
    WITH RECURSIVE b AS (SELECT doc_id, repository, band_key FROM {band_sql()} JOIN v_message USING (doc_id)),
    r AS (SELECT repository, doc_id, row_number() OVER (PARTITION BY repository ORDER BY doc_id % 7, doc_id) AS rank FROM v_message),
    seq AS (SELECT r.repository, r.rank, coalesce(list(b.band_key) FILTER (b.band_key IS NOT NULL), []) AS keys
            FROM r LEFT JOIN b USING (repository, doc_id) GROUP BY r.repository, r.rank),
    walk(repository, rank, seen, keep) AS (
      SELECT DISTINCT repository, 0::BIGINT, []::VARCHAR[], false FROM seq
      UNION ALL
      SELECT w.repository, s.rank, CASE WHEN list_has_any(seen, keys) THEN seen ELSE list_concat(seen, keys) END, NOT list_has_any(seen, keys)
      FROM walk w JOIN seq s ON s.repository = w.repository AND s.rank = w.rank + 1)
    SELECT r.doc_id FROM r JOIN walk USING (repository, rank) WHERE keep""")
def _(d):
    ranked = cut_lineage(d.sql("SELECT repository, doc_id, row_number() OVER (PARTITION BY repository ORDER BY doc_id % 7, doc_id) AS rank FROM v_message"))
    bands = TW.band_rows(d("v_message"), ["repository"], "doc_id", "message")
    return TW.remove_twins(ranked, bands, ["repository"], "doc_id", "rank").select("doc_id")


@query("rul_16_commit_has_twins", f"""
    WITH b AS (SELECT doc_id, repository, band_key FROM {band_sql()} JOIN v_message USING (doc_id)),
    s AS (SELECT repository, band_key FROM b GROUP BY ALL HAVING count(*) > 1)
    SELECT DISTINCT doc_id, 2 AS relevance FROM b JOIN s USING (repository, band_key) JOIN v_message m USING (doc_id)
    WHERE NOT starts_with(lower(m.message), 'merge')""")
def _(d):
    from vulnlake.operators import rules as RU

    commits = d("v_message")
    twins = TW.with_twins(TW.band_rows(commits, ["repository"], "doc_id", "message"), ["repository"], "doc_id")
    flagged = commits.join(twins.withColumn("has_twins", F.lit(True)), ["repository", "doc_id"], "left").withColumn(
        "has_twins", F.coalesce("has_twins", F.lit(False))).withColumn("_merge", RU.is_merge(F.col("message")))
    return RU.apply_rules(flagged, ["COMMIT_HAS_TWINS"]).filter("relevance > 0").select("doc_id", "relevance")


@query("rul_17_advisory_page_in_message", r"""
    SELECT doc_id FROM (SELECT doc_id, message || CASE WHEN doc_id % 7 = 0 THEN ' see GHSA-' || substr(commit_id, 1, 4) || '-' || substr(commit_id, 5, 4)
      || CASE WHEN doc_id % 2 = 0 THEN '-' || substr(commit_id, 9, 4) ELSE '' END ELSE '' END AS message FROM v_message)
    WHERE regexp_matches(message, 'GHSA(?:-[a-z0-9]{4}){3}')""")
def _(d):
    from vulnlake.operators import rules as RU

    c = F.col("commit_id")
    page = F.concat(F.lit(" see GHSA-"), c.substr(1, 4), F.lit("-"), c.substr(5, 4),
                    F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-"), c.substr(9, 4))).otherwise(""))
    commits = d("v_message").withColumn("message", F.concat("message", F.when(F.col("doc_id") % 7 == 0, page).otherwise("")))
    return RU.apply_rules(commits, ["ADVISORY_PAGE_IN_MESSAGE"], RU.OPTIONAL_RULES).filter("relevance > 0").select("doc_id")


NAMED = "(SELECT cve_id, doc_id FROM v_advisory_text JOIN v_message ON left(commit_id, 8) = left(md5(cast(item_id * 5 AS varchar)), 8))"


def _named(d):
    asked = d("v_advisory_text").select("cve_id", F.left(F.md5((F.col("item_id") * 5).cast("string")), F.lit(K.COMMIT_PREFIX)).alias("short"))
    return asked.join(d("v_message").select("doc_id", F.left("commit_id", F.lit(K.COMMIT_PREFIX)).alias("short")), "short").select("cve_id", "doc_id")


@query("rul_18_commit_in_advisory", f"SELECT cve_id, doc_id, 64 AS relevance FROM {NAMED}")
def _(d):
    from vulnlake.operators import rules as RU

    refs = d("v_advisory_text").select("cve_id", F.map_from_arrays(
        F.array(F.concat(F.lit("https://example.org/c/"), F.md5((F.col("item_id") * 5).cast("string")))), F.array(F.lit(2))).alias("references"))
    pairs = _named(d).join(d("v_message").select("doc_id", "commit_id"), "doc_id").join(refs, "cve_id")
    return RU.apply_rules(pairs, ["COMMIT_IN_ADVISORY"], RU.OPTIONAL_RULES).filter("relevance > 0").select("cve_id", "doc_id", "relevance")


@query("rul_19_twin_in_advisory", f"""
    WITH b AS ({band_sql()}), n AS {NAMED}
    SELECT DISTINCT n.cve_id, o.doc_id FROM n JOIN b ON b.doc_id = n.doc_id JOIN b o ON o.band_key = b.band_key AND o.doc_id <> n.doc_id""")
def _(d):
    return TW.twins_of_flagged(_named(d), _band_rows(d), ["cve_id"], [], "doc_id")


TAGS = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['v' || cast(doc_id % 5 AS varchar), 'v' || cast(doc_id % 3 AS varchar)] END AS tags FROM v_message)"


@query("joi_26_tags_of_twins", f"""
    WITH b AS ({band_sql()}), t AS {TAGS}, kept AS (SELECT doc_id FROM t WHERE list_contains(tags, 'v1')),
    pairs AS (SELECT DISTINCT b.doc_id, o.doc_id AS twin FROM b JOIN b o ON o.band_key = b.band_key AND o.doc_id <> b.doc_id
              WHERE b.doc_id IN (SELECT doc_id FROM kept))
    SELECT k.doc_id, 'v1' AS tag, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN len(t.tags) > 0 THEN t.tags[1] ELSE 'no-tag' END)
      FILTER (t.doc_id IS NOT NULL)), ','), '') AS twin_tags
    FROM kept k LEFT JOIN pairs p ON p.doc_id = k.doc_id LEFT JOIN t ON t.doc_id = p.twin GROUP BY k.doc_id""")
def _(d):
    def version(n: int):
        return F.concat(F.lit("v"), (F.col("doc_id") % n).cast("string"))

    commits = d("v_message").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(version(5), version(3))).alias("tags"))
    tagged = TW.tagged_commits(commits, _band_rows(d), [], "doc_id", F.lit("v1"))
    return tagged.select("doc_id", "tag", F.array_join("twin_tags", ",").alias("twin_tags"))


@query("fun_18_signature_range", f"""
    SELECT doc_id, min(m)::BIGINT AS lowest, max(m)::BIGINT AS highest FROM (
      SELECT doc_id, i, min((a * h + b) % {M.PRIME}) AS m
      FROM {HASHES} CROSS JOIN (VALUES {_permutations(128)}) p(i, a, b) GROUP BY doc_id, i) GROUP BY doc_id""")
def _(d):
    signed = d("v_message").select("doc_id", M.signature(M.token_hashes(_msg())).alias("s"))
    return signed.select("doc_id", F.array_min("s").alias("lowest"), F.array_max("s").alias("highest"))


SETS = r"""(SELECT min({id}) AS {id}, count(*) AS {n}, tokens FROM (
  SELECT {id}, list_sort(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS tokens FROM {table})
  WHERE len(tokens) > 0 GROUP BY tokens)"""
DOC_SETS = SETS.format(id="doc_id", n="n_docs", table="documents")


@query("joi_22_similar_documents", f"""
    WITH s AS (SELECT doc_id, n_docs, tokens, len(tokens) AS n FROM {DOC_SETS}),
         q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000000000000 + doc_id, text FROM documents),
         qs AS (SELECT query_id, n_queries, tokens, len(tokens) AS n FROM {SETS.format(id="query_id", n="n_queries", table="q")}),
         pairs AS (SELECT query_id, n_queries, doc_id, n_docs, qs.n + s.n AS total, len(list_intersect(qs.tokens, s.tokens)) AS i
                   FROM qs JOIN s ON qs.n >= s.n * 0.8 - 1e-9 AND s.n >= qs.n * 0.8 - 1e-9 AND
                   (qs.tokens[1] = s.tokens[1] OR list_has_any(qs.tokens[:greatest(1, qs.n // 5 + 2)], s.tokens[:greatest(1, s.n // 5 + 2)])))
    SELECT query_id, n_queries, doc_id, n_docs, round(i / (total - i), 9) AS jaccard FROM pairs WHERE i / (total - i) >= 0.8""")
def _(d):
    docs = d("documents").select("doc_id", "text")
    asked = d("benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(
        docs.select((F.col("doc_id") + 1000000000000).alias("query_id"), "text"))
    return TW.similar_texts(asked, docs).withColumn("jaccard", F.round("jaccard", 9))


# --- versions and tags ----------------------------------------------------------------------------------


@query("fun_19_clean_tags", r"""
    SELECT repo_url, tag, array_to_string(regexp_extract_all(tag, '\d+'), '.') AS digits,
           regexp_replace(tag, '[^0-9a-zA-Z]+', '.', 'g') AS dotted FROM v_tag""")
def _(d):
    tag = F.col("tag")
    return d("v_tag").select("repo_url", "tag", V.digits_of_tag(tag).alias("digits"), V.dotted_tag(tag).alias("dotted"))


@query("fun_20_tag_tests", r"""
    SELECT repo_url, tag, regexp_matches(lower(tag), '[^a-z]?rc[^a-z]|\d{9,}') AS is_rc,
           regexp_matches(tag, '[.-_]0$') AS ends_zero FROM v_tag""")
def _(d):
    tag = F.col("tag")
    return d("v_tag").select("repo_url", "tag", V.is_rc_or_date(tag).alias("is_rc"), V.ends_with_zero(tag).alias("ends_zero"))


def _tag_rows(d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("repo_url").orderBy("commit_ts", "tag")
    return d("v_tag").select("repo_url", "tag", F.row_number().over(w).alias("pos"))


def _asked_versions(d):
    return d("v_repo").select(
        F.col("repo_key").alias("id"), "repo_url", F.concat(F.col("repo_key").cast("string"), F.lit(".1")).alias("version"))


@query("fun_21_tags_of_intervals")
def _(d):
    asked = d("v_repo").select(
        F.col("repo_key").alias("id"), "repo_url",
        F.concat(F.col("repo_key").cast("string"), F.lit(".1:"), F.col("repo_key").cast("string"), F.lit(".3")).alias("interval"))
    return TG.tags_of_intervals(_tag_rows(d), asked)


@query("fun_22_closest_tags")
def _(d):
    return TG.closest_tag(_tag_rows(d), _asked_versions(d))


@query("fun_22_close_tag_candidates")
def _(d):
    tags = _tag_rows(d).select("repo_url", V.digits_of_tag(F.col("tag")).alias("version_key"), "tag")
    asked = _asked_versions(d).withColumn("other", F.concat(F.col("id").cast("string"), F.lit(".9")))
    return TG.close_tags(tags, asked, before=True)


def _near(words: list[str]) -> str:
    has = " OR ".join(f"contains(s, '{w}')" for w in words)
    return rf"""list_last(flatten(list_transform(list_filter(string_split_regex(text, '[.!?]\s+|\n'), lambda s: {has}),
      lambda s: regexp_extract_all(s, '\d+\.(?:\d+\.*)*\d'))))"""


@query("fun_23_versions_in_text", f"""
    SELECT doc_id, {_near(K.AFFECTED_VERSION_WORDS)} AS affected, {_near(K.FIXED_VERSION_WORDS)} AS fixed
    FROM (SELECT doc_id, replace(replace(text, ' with ', ' through '), ' is ', ' before ') AS text FROM documents)""")
def _(d):
    text = F.replace(F.replace("text", F.lit(" with "), F.lit(" through ")), F.lit(" is "), F.lit(" before "))
    affected, fixed = V.affected_and_fixed(F.col("text"))
    return d("documents").withColumn("text", text).select("doc_id", affected.alias("affected"), fixed.alias("fixed"))


@query("fun_24_cpe_products", r"""
    SELECT p_partkey, trim(regexp_replace(array_to_string(list_slice(string_split(cpe, ':'), 4, 5), ':'), '\\(.)', '\1', 'g'), '/\') AS product
    FROM (SELECT p_partkey, 'cpe:2.3:a:' || lower(p_brand) || ':' || replace(p_name, ' ', '\/') || '\/:1.0:*' AS cpe FROM part)""")
def _(d):
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.lower("p_brand"), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("\\/")), F.lit("\\/:1.0:*"))
    return d("part").select("p_partkey", U.cpe_product(cpe).alias("product"))


@query("fun_25_method_code", """
    SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS code FROM documents""")
def _(d):
    return d("documents").select("doc_id", X.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


@query("fun_26_runtime_parts", """
    SELECT o_orderkey, s // 3600 AS hours, (s % 3600) // 60 AS minutes, s % 60 AS seconds
    FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS s FROM orders)""")
def _(d):
    from vulnlake.functions.times import runtime_parts

    h, m, s = runtime_parts(F.floor("o_totalprice"))
    return d("orders").select("o_orderkey", h.alias("hours"), m.alias("minutes"), s.alias("seconds"))


@query("fun_27_times", """
    SELECT o_orderkey, cast(epoch(o_orderdate) AS bigint) AS seconds, cast(o_orderdate AS date) AS day,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text FROM orders""")
def _(d):
    from vulnlake.functions.times import epoch_of_iso, utc_text

    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d("orders").select("o_orderkey", epoch_of_iso(iso).alias("seconds"), F.to_date("o_orderdate").alias("day"),
                              utc_text(F.col("o_orderdate")).alias("text"))


@query("fun_28_project_names", """
    SELECT repo_url, replace(string_split(repo_url, '/')[-1], '-', '_') AS name, coalesce(commits_count, 0) AS commits FROM v_repository""")
def _(d):
    return d("v_repository").select(
        "repo_url", F.replace(U.last_part(F.col("repo_url")), F.lit("-"), F.lit("_")).alias("name"),
        F.coalesce("commits_count", F.lit(0)).cast("long").alias("commits"))


@query("fun_29_json_values", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def _(d):
    parsed = F.from_json(F.to_json(F.from_json("props", "k long")), "k long")
    return d("events").select("event_id", parsed["k"].alias("k"))


@query("fun_30_languages", """
    SELECT file_change_id, CASE WHEN num_lines_added = 0 THEN 'unknown' WHEN ends_with(filename, '.js') THEN 'JavaScript'
      WHEN ends_with(filename, '.py') THEN 'Python' ELSE 'C' END AS language FROM v_file_change""")
def _(d):
    code = F.when(F.col("num_lines_added") > 0, F.col("diff"))
    return d("v_file_change").select("file_change_id", X.language(F.col("filename"), code).alias("language"))


@query("fun_31_one_line", """
    SELECT doc_id, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), ' ')) AS line FROM documents""")
def _(d):
    return d("documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


@query("fun_34_signed_day_interval", """
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN n >= 0 THEN t BETWEEN v AND v + n * 86400 ELSE t BETWEEN v + n * 86400 AND v END AS inside, t - v AS seconds
    FROM (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, cast(epoch(o_orderdate) AS bigint) AS v,
                 cast(epoch(l_shipdate) AS bigint) AS t, cast(l_quantity AS bigint) - 10 AS n
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def _(d):
    from vulnlake.functions.times import within_signed_days

    v, t, n = F.unix_timestamp("o_orderdate"), F.unix_timestamp("l_shipdate"), F.col("l_quantity").cast("long") - 10
    rows = d("lineitem").join(d("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       within_signed_days(v, t, n).alias("inside"), (t - v).alias("seconds"))


@query("fun_35_other_cves", f"SELECT * FROM ({_found(r'CVE-[0-9]{4}-[0-9]{4,8}', 0, 'cve')}) WHERE cve <> 'CVE-2024-1011'")
def _(d):
    return _rows(d, F.array_except(X.cve_ids(_msg()), F.array(F.lit("CVE-2024-1011"))), "cve")


# --- diffs -----------------------------------------------------------------------------------------------

LINES = "(SELECT doc_id, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS pos FROM v_diff)"

DIFF_ROWS = rf"""
    WITH r AS (SELECT doc_id, pos, line, starts_with(line, '@@') AS head,
                 CASE WHEN starts_with(line, '@@') OR starts_with(line, '+++') OR starts_with(line, '---') OR line[1] = '\' THEN 'none'
                      WHEN line[1] = '+' THEN 'added' WHEN line[1] = '-' THEN 'deleted' ELSE 'both' END AS side,
                 try_cast(regexp_extract(line, '^@@ -(\d+)(?:,\d+)? \+(\d+)', 1) AS integer) AS o,
                 try_cast(regexp_extract(line, '^@@ -(\d+)(?:,\d+)? \+(\d+)', 2) AS integer) AS n FROM {LINES}),
         h AS (SELECT *, sum(head::int) OVER (PARTITION BY doc_id ORDER BY pos) AS hunk FROM r),
         k AS (SELECT *, max(o) OVER w + count(*) FILTER (WHERE side IN ('deleted', 'both')) OVER w - 1 AS del,
                      max(n) OVER w + count(*) FILTER (WHERE side IN ('added', 'both')) OVER w - 1 AS add
               FROM h WINDOW w AS (PARTITION BY doc_id, hunk ORDER BY pos))
    SELECT doc_id, side, CASE side WHEN 'added' THEN add ELSE del END AS line, substr(line, 2) AS text FROM k
    WHERE side IN ('added', 'deleted') AND hunk > 0"""


@query("exp_07_diff_lines", DIFF_ROWS)
def _(d):
    return D.diff_lines(d("v_diff"), "doc_id", "diff")


@query("win_09_highest_line", f"SELECT doc_id, side, max(line) AS last_line, count(*) AS n FROM ({DIFF_ROWS}) GROUP BY 1, 2")
def _(d):
    return D.diff_lines(d("v_diff"), "doc_id", "diff").groupBy("doc_id", "side").agg(
        F.max("line").alias("last_line"), F.count("*").alias("n"))


@query("exp_08_hunk_counts", f"""
    WITH r AS (SELECT doc_id, pos, line[1] IN ('+', '-') AS c FROM {LINES}
               WHERE trim(line) <> '' AND substr(line, 1, 3) NOT IN ('+++', '---')),
         s AS (SELECT doc_id, c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM r)
    SELECT doc_id, count(*) FILTER (WHERE starts) AS hunks FROM s GROUP BY doc_id""")
def _(d):
    return d("v_diff").select("doc_id", D.hunk_count(F.split("diff", "\n")).cast("long").alias("hunks"))
