"""Weighted rules over (commit, advisory) rows.

A rule is a column that lists the evidence it finds; it holds when the list is not empty.  All rules are
evaluated side by side on the same narrow row: texts, changed lines and pages are searched once per commit for the terms
of all its advisories, and a (commit, advisory) row carries only what was found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import constants as K
from vulnlake.functions import text as X
from vulnlake.functions import urls as U
from vulnlake.functions.search import contained
from vulnlake.operators.twins import twins_of_flagged

NO_EVIDENCE = "array<string>"
ADVISORY = ("keywords", "files", "references")


@dataclass(frozen=True)
class Rule:
    """``evidence`` builds an array of texts from the row; ``message`` goes before the joined evidence.

    ``uses`` names what it looks at of the advisory, which is all that pairs carry of it.
    """

    id: str
    weight: int
    evidence: Callable[[], Column]
    message: str
    lists_evidence: bool = True
    uses: tuple[str, ...] = ADVISORY

    def found(self) -> Column:
        return F.coalesce(F.size(F.col(f"_{self.id}")) > 0, F.lit(False))

    def text(self) -> Column:
        if not self.lists_evidence:
            return F.lit(self.message)
        return F.concat(F.lit(self.message), F.array_join(F.col(f"_{self.id}"), ", "))


def commit_features(commits: DataFrame, issues: DataFrame, tickets: DataFrame) -> DataFrame:
    """Everything about a commit that no advisory is needed for, computed once per commit.

    ``commits``: ``commit_id, repository, message, changed_files, diff``; ``issues`` and ``tickets``:
    ``(repository, issue_id, content)`` of linked pages that were stored.
    """
    ids = commits.select(
        "commit_id", "repository", X.issue_ids(F.col("message")).alias("_issues"),
        X.jira_keys(F.col("repository"), F.col("message")).alias("_tickets"))
    linked = _linked(ids, "_issues", issues, "ghissue_refs").join(
        _linked(ids, "_tickets", tickets, "jira_refs"), ["commit_id", "repository"], "full")
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return commits.join(linked, ["commit_id", "repository"], "left").withColumns({
        "cve_refs": X.cve_ids(F.col("message")),
        **{name: F.coalesce(name, none) for name in ("ghissue_refs", "jira_refs")},
    })


def _linked(commits: DataFrame, ids: str, pages: DataFrame, name: str) -> DataFrame:
    """Map of linked id -> stored content, empty text where nothing is stored, for the commits that link any."""
    mentions = commits.select("commit_id", "repository", F.explode(ids).alias("issue_id")).distinct()
    pages = pages.groupBy("repository", "issue_id").agg(F.max("content").alias("content"))  # one page for each link
    return (
        mentions.join(pages, ["repository", "issue_id"], "left")
        .groupBy("commit_id", "repository")
        .agg(
            F.sort_array(F.collect_list(F.struct("issue_id", F.coalesce("content", F.lit("")).alias("content"))))
            .alias("_entries")
        )
        .select("commit_id", "repository", F.map_from_entries("_entries").alias(name))
    )


def is_merge(message: Column) -> Column:
    return F.startswith(F.lower(F.left(message, F.lit(5))), F.lit("merge"))


def _single_mentions() -> Column:
    """Linked pages that name one CVE only, with its id as far as its digits go."""
    pages = F.concat(F.map_entries("ghissue_refs"), F.map_entries("jira_refs"))
    one = F.filter(pages, lambda e: F.size(F.regexp_extract_all(e["value"], F.lit(r"CVE-\d{4}-\d{4,8}"), F.lit(0))) == 1)
    return F.transform(one, lambda e: F.struct(
        e["key"].alias("id"), F.regexp_extract(e["value"], r"CVE-\d{4}-\d{4,}", 0).alias("mention")))


def _keywords_in_pages(pages: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(
        F.transform(F.map_values(pages), lambda text: X.security_keywords(text)))))


def commit_evidence(files: Column, keywords: Column) -> dict[str, Column]:
    """What the rules need of a commit, in narrow columns: nothing of it is a text or a page.

    ``files`` and ``keywords`` are the terms of the advisories for which the commit is a candidate; the commit's message,
    paths and changed lines are searched for them here, once per commit.
    """
    paths = F.transform("changed_files", lambda f: F.lower(f))
    own = F.split("repository", "/")
    header = ["diff --git", "---", "+++"]
    code = F.array_join(F.filter("diff", lambda line: ~U.any_of([line.contains(h) for h in header])), "\n")
    usable = F.filter(files, lambda f: ~F.array_contains(own, F.lower(f)) & ~F.contains(f, F.lit("\n")))
    known = F.filter(F.array_distinct(F.transform(files, lambda f: F.lower(f))), lambda f: (F.length(f) > 3) & ~F.array_contains(own, f))
    message = F.lower("message")
    return {
        "_cve_refs": F.col("cve_refs"),
        "_issue_ids": F.map_keys("ghissue_refs"),
        "_ticket_ids": F.map_keys("jira_refs"),
        "_mentions": _single_mentions(),
        "_merge": is_merge(F.col("message")),
        "_code_hits": contained(usable, F.when(F.size(usable) > 0, code)),
        "_file_hits": F.filter(
            F.transform("changed_files", lambda c: F.struct(
                c.alias("file"), F.filter(known, lambda f: F.contains(F.lower(c), f)).alias("terms"))),
            lambda h: F.size(h["terms"]) > 0),
        "_word_hits": F.array_intersect(files, X.words(F.col("message"))),
        "_path_hits": F.filter(keywords, lambda k: ~F.contains("repository", F.lower(k)) & F.exists(paths, lambda c: F.contains(c, F.lower(k)))),
        "_message_hits": contained(F.filter(keywords, lambda k: ~F.contains("repository", k)), message),
        "_sec_message": X.security_keywords(F.col("message")),
        "_sec_issues": _keywords_in_pages("ghissue_refs"),
        "_sec_tickets": _keywords_in_pages("jira_refs"),
    }


def _refs() -> Column:
    return F.map_keys("references")


def _sorted(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def _vuln_id() -> Column:
    only = (F.size("_cve_refs") == 1) & F.array_contains("_cve_refs", F.col("cve_id"))
    return F.when(only, F.col("_cve_refs"))


def _xref_bug() -> Column:
    return _sorted(F.filter(
        "_ticket_ids", lambda k: F.exists(_refs(), lambda r: r.contains(k) & r.contains("jira"))))


def _xref_issue() -> Column:
    own = F.filter(_refs(), lambda r: F.startswith(r, F.col("repository")))
    return _sorted(F.filter(
        "_issue_ids", lambda k: F.exists(own, lambda r: F.array_contains(F.split(r, "/"), k))))


def _in_reference() -> Column:
    hits = F.filter(
        F.map_entries("references"), lambda e: F.contains(e["key"], F.left("commit_id", F.lit(K.COMMIT_PREFIX))))
    return F.transform(hits, lambda e: e["value"].cast("string"))


def _in_linked_page() -> Column:
    named = F.filter("_mentions", lambda m: F.startswith(m["mention"], F.col("cve_id")))
    return _sorted(F.transform(named, lambda m: m["id"]))


def _changed_relevant() -> Column:
    lower = F.transform("files", lambda f: F.lower(f))
    return _sorted(F.transform(F.filter("_file_hits", lambda h: F.arrays_overlap(h["terms"], lower)), lambda h: h["file"]))


def _listed(terms: str, hits: str) -> Callable[[], Column]:
    return lambda: _sorted(F.array_intersect(terms, hits))


RULES: list[Rule] = [
    Rule("VULN_ID_IN_MESSAGE", 64, _vuln_id, "The commit message mentions the vulnerability ID", False, uses=()),
    Rule("XREF_BUG", 32, _xref_bug,
         "The commit and the advisory (including referenced pages) mention the same bug tracking ticket: ", uses=("references",)),
    Rule("XREF_GH", 32, _xref_issue,
         "The commit and the advisory (including referenced pages) mention the same github issue: ", uses=("references",)),
    Rule("COMMIT_IN_REFERENCE", 64, _in_reference, "This commit is mentioned in the references, times: ", uses=("references",)),
    Rule("VULN_ID_IN_LINKED_ISSUE", 32,
         _in_linked_page,
         "Pages linked to the commit that mention the Vuln ID: ", uses=()),
    Rule("CHANGES_RELEVANT_FILES", 8, _changed_relevant, "The commit changes some relevant files: ", uses=("files",)),
    Rule("CHANGES_RELEVANT_CODE", 8, _listed("files", "_code_hits"),
         "The commit modifies code containing relevant filename or methods: ", uses=("files",)),
    Rule("RELEVANT_WORDS_IN_MESSAGE", 8, _listed("files", "_word_hits"),
         "The commit message contains some relevant words: ", uses=("files",)),
    Rule("ADV_KEYWORDS_IN_FILES", 4, _listed("keywords", "_path_hits"),
         "An advisory keyword is contained in the changed files: ", uses=("keywords",)),
    Rule("ADV_KEYWORDS_IN_MSG", 4, _listed("keywords", "_message_hits"),
         "The commit message and the advisory description contain the following keywords: ", uses=("keywords",)),
    Rule("SEC_KEYWORDS_IN_MESSAGE", 4, lambda: F.col("_sec_message"),
         "The commit message contains some security-related keywords: ", uses=()),
    Rule("SEC_KEYWORDS_IN_LINKED_GH", 4, lambda: F.col("_sec_issues"),
         "The linked github issues contain some security-related terms: ", uses=()),
    Rule("SEC_KEYWORDS_IN_LINKED_BUG", 4, lambda: F.col("_sec_tickets"),
         "The linked bug tracking tickets contain some security-related terms: ", uses=()),
    Rule("GITHUB_ISSUE_IN_MESSAGE", 2, lambda: _sorted(F.col("_issue_ids")),
         "The commit message references some github issue: ", uses=()),
    Rule("BUG_IN_MESSAGE", 2, lambda: _sorted(F.col("_ticket_ids")),
         "The commit message references some bug tracking ticket: ", uses=()),
    Rule("COMMIT_HAS_TWINS", 2,
         lambda: F.when(F.col("has_twins") & ~F.col("_merge"), F.array(F.lit("twin"))),
         "This commit has one or more twins.", False, uses=()),
]

def _in_advisory() -> Column:
    return _sorted(F.filter(_refs(), lambda r: F.contains(r, F.left("commit_id", F.lit(K.COMMIT_PREFIX)))))


#: Rules that are not in the default list; ``apply_rules(pairs, ids, RULES + OPTIONAL_RULES)`` uses them too.
OPTIONAL_RULES: list[Rule] = [
    Rule("COMMIT_IN_ADVISORY", 64, _in_advisory, "The commit is mentioned in the advisory page", False, uses=("references",)),
    Rule("TWIN_IN_ADVISORY", 64, lambda: F.when(F.col("twin_in_advisory"), F.array(F.lit("twin"))),
         "A twin of this commit is mentioned in the advisory page", False, uses=()),
    Rule("ADVISORY_PAGE_IN_MESSAGE", 16, lambda: F.when(mentions_advisory_page(F.col("message")), F.array(F.lit("page"))),
         "The commit message mentions an advisory page", False, uses=()),
]

def enabled_rules(ids: Sequence[str] = ("ALL",), rules: Sequence[Rule] = RULES) -> list[Rule]:
    return list(rules) if "ALL" in ids else [r for r in rules if r.id in ids]


def with_evidence(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumns({f"_{r.id}": F.coalesce(r.evidence(), F.array().cast(NO_EVIDENCE)) for r in rules})


def matched_rules(rules: Sequence[Rule]) -> Column:
    """Matched rules in report order.

    A new match goes before the earlier ones of its weight and after all others: rules of a weight stay
    together where the first of them stood, latest first.
    """
    def block(r: Rule) -> Column:
        return F.coalesce(*[F.when(o.found(), F.lit(i)) for i, o in enumerate(rules) if o.weight == r.weight])

    placed = F.array_compact(F.array(*[
        F.when(
            r.found(),
            F.struct(
                block(r).alias("block"), F.lit(-i).alias("late"),
                F.lit(r.id).alias("id"), r.text().alias("message"), F.lit(r.weight).alias("relevance"),
            ),
        )
        for i, r in enumerate(rules)
    ]))
    return F.transform(
        F.array_sort(placed),
        lambda m: F.struct(m["id"].alias("id"), m["message"].alias("message"), m["relevance"].alias("relevance")),
    )


def relevance(rules: Sequence[Rule]) -> Column:
    """Sum of the weights of the rules that hold."""
    total = F.lit(0)
    for r in rules:
        total = total + F.when(r.found(), r.weight).otherwise(0)
    return total


def apply_rules(pairs: DataFrame, ids: Sequence[str] = ("ALL",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``relevance`` and ``matched_rules`` to (commit, advisory) rows that carry the columns the rules look at."""
    active = enabled_rules(ids, rules)
    scored = (
        with_evidence(pairs, active)
        .withColumn("relevance", relevance(active))
        .withColumn("matched_rules", matched_rules(active))
    )
    return scored.drop(*[f"_{r.id}" for r in active])


def score_pairs(
    pairs: DataFrame, features: DataFrame, advisories: DataFrame, ids: Sequence[str] = ("ALL",),
    rules: Sequence[Rule] = RULES, together: int = 64,
) -> DataFrame:
    """Pairs with ``relevance`` and ``matched_rules``; ``pairs`` has ``(cve_id, repository, commit_id, ..)``.

    ``features`` are the commits (``commit_features``), ``advisories`` have ``(cve_id, repository, keywords, files,
    references)``.  The pairs of a commit are gathered about ``together`` at a time with their advisories' terms, so a
    commit's text is read and searched once for that many pairs and never copied to a pair; what the rules then see
    are the terms it holds.  A commit with any number of candidates just has more such groups.
    """
    key = ["repository", "commit_id"]
    used = [c for c in ADVISORY if any(c in r.uses for r in enabled_rules(ids, rules))]
    known = advisories.select("cve_id", "repository", *used)
    # a fixed number of tasks: ids and terms shrink so much in a shuffle that tasks chosen by its size hold too many rows
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, *key)
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("cve_id"), F.ceil(F.col("_n") / together))
    own = [c for c in pairs.columns if c not in key]
    rows = dealt.join(sizes, key).withColumn("_part", part).join(known, ["cve_id", "repository"])
    spread = rows.repartition(tasks, *key)  # none where terms were broadcast, since the rows still lie so
    members = spread.groupBy(*key, "_part").agg(F.collect_list(F.struct(*own, *used)).alias("_members"))
    terms = {c: F.array_distinct(F.flatten(F.col("_members")[c])) if c in used else F.array().cast(NO_EVIDENCE) for c in ("files", "keywords")}
    groups = members.select(*key, "_members", *[c.alias(f"_{n}") for n, c in terms.items()])
    evidence = commit_evidence(F.col("_files"), F.col("_keywords"))
    searched = groups.join(features, key).select(*key, "_members", *[c.alias(n) for n, c in evidence.items()])
    spread = searched.select(*key, *evidence, F.explode("_members").alias("_m")).select(*key, *evidence, "_m.*")
    return apply_rules(spread, ids, rules).drop(*evidence, "keywords", "files", "references")


def with_twin_mentions(pairs: DataFrame, bands: DataFrame, scope: Sequence[str] = ("repository",)) -> DataFrame:
    """Add ``twin_in_advisory``: a twin of the commit is named in a reference of the pair's advisory.

    Which commits the references name is found once per pair; the band rows carry it to the twins.
    """
    named = pairs.filter(F.size(_in_advisory()) > 0).select("cve_id", *scope, "commit_id").distinct()
    reached = twins_of_flagged(named, bands, ["cve_id"], scope, "commit_id").withColumn("twin_in_advisory", F.lit(True))
    return pairs.join(reached, ["cve_id", *scope, "commit_id"], "left").withColumn(
        "twin_in_advisory", F.coalesce("twin_in_advisory", F.lit(False)))


def mentions_advisory_page(message: Column) -> Column:
    """Message names a GitHub advisory."""
    return message.rlike(r"GHSA(?:-[a-z0-9]{4}){3}")
