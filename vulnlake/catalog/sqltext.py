"""DuckDB expressions shared by the oracle texts."""

from vulnlake import constants as K

NAMES = ", ".join(f"'{n}'" for n in dict.fromkeys(x.lower() for x in K.BLACKLIST_NAMES))
HOSTS = "|".join(K.ALLOWED_HOSTS)
HOST_CASES = " ".join(f"WHEN '{h}' THEN '{e}'" for h, e in K.REGISTRY_HOSTS.items())
KEYWORDS = "[" + ", ".join(f"'{w}'" for w in K.SECURITY_KEYWORDS) + "]"
IRRELEVANT = "[" + ", ".join(f"'{w}'" for w in K.IRRELEVANT_FILE_PARTS) + "]"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def base(url: str) -> str:
    trimmed = f"regexp_replace({path(url)}, '^/+|/+$', '', 'g')"
    return (
        f"('https://' || {host(url)} || '/' || array_to_string(list_slice(string_split({trimmed}, '/'), 1, 2), '/'))"
    )


def clean_git(url: str) -> str:
    for prefix in (r"git\+", "git://", "https://", "http://", "ssh://"):
        url = f"regexp_replace({url}, '^{prefix}', '')"
    url = rf"regexp_replace({url}, '\.git$', '')"
    return f"('https://' || replace(replace({url}, 'git@', ''), '/tree/main', ''))"


def is_repo(url: str) -> str:
    return rf"regexp_matches({url}, '^https?://(www\.)?github\.com/[^/]+/[^/]*')"


def blacklisted(url: str) -> str:
    name = f"string_split({url}, '/')[-1]"
    return f"(regexp_matches({name}, '{K.BLACKLIST_WORDS}') OR lower({name}) IN ({NAMES}))"


def ecosystem(url: str) -> str:
    return rf"(CASE regexp_replace({host(url)}, '^www\.', '') {HOST_CASES} END)"


def package(url: str) -> str:
    clean = f"regexp_replace({url}, '[?#].*$', '')"
    at = f"regexp_replace({url}, '[?#@].*$', '')"
    return rf"""(CASE {ecosystem(clean)}
      WHEN 'NPM' THEN nullif(regexp_extract({path(clean)}, '^/package/(.+)', 1), '')
      WHEN 'GO' THEN nullif(regexp_replace({path(at)}, '^/+|/+$', '', 'g'), '')
      WHEN 'RUBYGEMS' THEN string_split({clean}, '/')[5]
      WHEN 'COMPOSER' THEN nullif(regexp_replace(regexp_extract({path(clean)}, '^/packages/(.+)', 1), '\.json$', ''), '')
      WHEN 'PYPI' THEN nullif(regexp_extract({clean}, '^https?://(?:www\.)?pypi\.org/project/([^/]*)', 1), '')
      WHEN 'CARGO' THEN nullif(regexp_extract({clean}, 'https://crates\.io/crates/([\w-]+)', 1), '')
      WHEN 'NUGET' THEN nullif(regexp_extract({clean}, 'https://www\.nuget\.org/packages/([\w.-]+)', 1), '') END)"""


COMMIT_RE = r"(https?://github\.com/[^/]+/[^/]*)/commits?/([0-9a-fA-F]+)"
RESOURCE_RE = (
    r"(https?://github\.com/[^/]+/[^/]*)/(?:releases|issues|commits|commit|pull|security/advisories)"
)

PACKAGE_REPOS = f"""(
    SELECT ecosystem, name, arg_min(repo, (late, repo)) AS repo_url FROM (
      SELECT ecosystem, name, label <> 'SOURCE_REPO' AS late, url,
             CASE WHEN label = 'SOURCE_REPO' THEN {clean_git('url')} ELSE {base(clean_git('url'))} END AS repo
      FROM v_package_links)
    WHERE {is_repo('repo')} AND (ecosystem <> 'RUBYGEMS' OR contains(url, name)) GROUP BY 1, 2)"""

LINKS = f"""(
    SELECT cve_id, pos, link, class, class > 1 AND {blacklisted('link')} AS black FROM (
      SELECT cve_id, pos, url AS link, 1 AS class FROM v_ref WHERE regexp_matches(url, '{COMMIT_RE}')
      UNION ALL
      SELECT cve_id, pos, {base('url')}, 2 FROM v_ref
      WHERE NOT regexp_matches(url, '{COMMIT_RE}') AND {host('url')} = 'github.com' AND {is_repo(base('url'))}
      UNION ALL
      SELECT cve_id, pos, {base('url')}, 3 FROM v_ref
      WHERE NOT regexp_matches(url, '{COMMIT_RE}') AND {host('url')} = 'www.github.com' AND {is_repo(base('url'))}
      UNION ALL
      SELECT cve_id, pos, p.repo_url, 3 FROM v_ref r JOIN {PACKAGE_REPOS} p
        ON p.ecosystem = {ecosystem('r.url')} AND p.name = {package('r.url')}))"""

BEST = f"""(
    SELECT cve_id, arg_min(link, (class, pos, link)) FILTER (WHERE NOT black) AS link,
           arg_min(class, (class, pos, link)) FILTER (WHERE NOT black) AS class,
           min(pos) FILTER (WHERE NOT black AND class = 2) AS p2, min(pos) FILTER (WHERE NOT black AND class = 3) AS p3,
           bool_or(class = 1) AS has1
    FROM {LINKS} GROUP BY cve_id)"""

BEST_LINK = f"""
    SELECT b.cve_id, b.link,
           CASE b.class WHEN 1 THEN 'DIRECT_COMMIT' WHEN 2 THEN 'GIT_REPOBASED' WHEN 3 THEN 'REGISTRY' END AS rel_type,
           (SELECT count(*) FROM {LINKS} l WHERE l.cve_id = b.cve_id AND l.black AND NOT b.has1
              AND ((l.class = 2 AND (b.p2 IS NULL OR l.pos < b.p2))
                OR (l.class = 3 AND b.p2 IS NULL AND (b.p3 IS NULL OR l.pos < b.p3)))) AS blacklisted
    FROM {BEST} b"""
