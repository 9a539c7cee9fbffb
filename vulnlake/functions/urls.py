"""Url expressions: hosts, repositories, commits, registries and packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake import constants as K


def not_blank(col: Column) -> Column:
    return F.when(col != "", col)


def group(url: Column, pattern: str, index: int) -> Column:
    """A regex group, NULL when there is no match."""
    return not_blank(F.regexp_extract(url, pattern, index))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def plain_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def last_part(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def without_query(url: Column, *extra: str) -> Column:
    """Everything before the first ``?`` or ``#`` (or one of the extra separators)."""
    return F.regexp_replace(url, "(?s)[?#" + "".join(extra) + "].*$", "")


def base_repo_url(url: Column) -> Column:
    """https, the host and the first two path parts."""
    parts = F.slice(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"), 1, 2)
    return F.concat(F.lit("https://"), host(url), F.lit("/"), F.array_join(parts, "/"))


def github_base(url: Column, www: bool = False) -> Column:
    """Base url of a GitHub page, NULL for any other url; one pattern, so it stays cheap to repeat in a plan."""
    hosts = r"www\.github\.com" if www else r"github\.com"
    return F.concat(F.lit("https://"), group(url, rf"(?i)^[a-z]+://({hosts}/+[^/?#]+/[^/?#]+)", 1))


def is_github_repo(url: Column) -> Column:
    return F.coalesce(url.rlike(K.GITHUB_REPO), F.lit(False))


def clean_git_url(url: Column) -> Column:
    """Git prefixes in their fixed order, ``.git``, user part and main tree removed, https in front."""
    for prefix in (r"git\+", "git://", "https://", "http://", "ssh://"):
        url = F.regexp_replace(url, f"^{prefix}", "")
    url = F.regexp_replace(url, r"\.git$", "")
    return F.concat(F.lit("https://"), F.replace(F.replace(url, F.lit("git@"), F.lit("")), F.lit("/tree/main"), F.lit("")))


def github_owner(url: Column) -> Column:
    return group(url, r"^[a-z]+://github\.com/+([^/?#]+)/+[^/?#]+", 1)


def github_name(url: Column) -> Column:
    return F.regexp_replace(group(url, r"^[a-z]+://github\.com/+[^/?#]+/+([^/?#]+)", 1), r"\.git$", "")


def is_blacklisted(url: Column) -> Column:
    name = last_part(url)
    return name.rlike(K.BLACKLIST_WORDS) | F.lower(name).isin([n.lower() for n in K.BLACKLIST_NAMES])


def is_allowed_host(url: Column) -> Column:
    return host(url).rlike("|".join(K.ALLOWED_HOSTS))


def commit_repo(url: Column) -> Column:
    """Repository of a direct commit url, https."""
    return F.regexp_replace(group(url, K.COMMIT_URL, 1), "^http:", "https:")


def commit_hash(url: Column) -> Column:
    return group(url, K.COMMIT_URL, 2)


def resource_repo(url: Column) -> Column:
    """Repository of a release, issue, commit, pull or advisory page."""
    return F.regexp_replace(group(url, K.RESOURCE_URL, 1), "^http:", "https:")


def commit_reference(url: Column) -> Column:
    """``commit::<hash>`` for a url that names a commit, else the url."""
    found = F.coalesce(
        F.when(url.contains("a=commit;"), group(url, r";h=(\w{6,40})", 1)),
        group(url, r"commits?/(\w{6,40})", 1),
        group(url, r"(?:commit|patch)/\?id=(\w{6,40})", 1),
    )
    return F.coalesce(F.concat(F.lit("commit::"), found), url)


def commit_page(repo: Column, commit: Column) -> Column:
    middle = F.when(repo.contains("gitlab."), F.lit("/-/commit/")).otherwise(F.lit("/commit/"))
    return F.concat(repo, middle, commit)


def flat_name(url: Column) -> Column:
    """Host and path as one file name."""
    trimmed = F.regexp_replace(url, "/+$", "")
    return F.concat(
        F.regexp_extract(trimmed, r"^[a-z]+://([^/?#]*)", 1), F.replace(path(trimmed), F.lit("/"), F.lit("_"))
    )


def patch_name(repo: Column, commit: Column) -> Column:
    flat = F.replace(F.regexp_replace(repo, "^https://", ""), F.lit("/"), F.lit("_"))
    return F.concat(flat, F.lit("_"), commit, F.lit(".patch"))


def registry_ecosystem(url: Column) -> Column:
    """Registry that the host of ``url`` belongs to."""
    pairs = [F.lit(x) for item in K.REGISTRY_HOSTS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), plain_host(url))


def normal_ecosystem(name: Column) -> Column:
    """Registry name as written in an advisory -> one known name, NULL for an unknown registry."""
    upper = F.upper(name)
    upper = F.when(upper == "PIP", "PYPI").when(upper.contains("CRATES"), "CARGO").otherwise(upper)
    return (
        F.when(upper.isin(K.DIRECT_ECOSYSTEMS), upper)
        .when(upper.contains("RUBY") | upper.contains("GEMS"), "RUBYGEMS")
        .when(upper.contains("PACKAGIST") | upper.contains("COMPOSER"), "COMPOSER")
    )


def package_name(url: Column) -> Column:
    """Package a registry page is about; at most one of the patterns fits, so the parts are simply joined."""
    patterns = [
        r"^https?://(?:www\.)?npmjs\.com/package/([^?#]+)",
        r"^https?://(?:www\.)?pkg\.go\.dev/+(?!vuln/GO-)([^?#@]*[^?#@/])",
        r"^https?://(?:www\.)?rubygems\.org/[^/?#]*/([^/?#]*)",
        r"^https?://(?:www\.)?packagist\.org/packages/([^?#]+?)(?:\.json)?(?:[?#]|$)",
        r"^https?://(?:www\.)?pypi\.org/project/([^/?#]*)",
        K.CRATE_PAGE,
        K.NUGET_PAGE,
    ]
    return not_blank(F.concat(*[F.regexp_extract(url, p, 1) for p in patterns]))


def cpe_product(name: Column) -> Column:
    """``vendor:product`` of a CPE 2.3 name, escapes and stray slashes removed."""
    joined = F.array_join(F.slice(F.split(name, ":"), 4, 2), ":")
    return F.regexp_replace(F.regexp_replace(joined, r"\\(.)", "$1"), r"^[/\\]+|[/\\]+$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
