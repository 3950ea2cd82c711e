"""URL expressions: parts, resolution against a base, validity.

Built-in functions only. Spark's ``parse_url`` rejects many addresses found in the
wild (blanks, pipes), so the generic URI grammar is applied as regular expressions.
A URL whose authority cannot be read (unbalanced or bad brackets) resolves to NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteindex.constants import DISCOVERY_SKIP, SITEMAP_SKIP
from siteindex.functions.text import contains_any, contains_any_of, strip, title_case

# --- fixed values: schemes whose references may be relative (RFC 3986 practice) ---
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
# those of them whose last path segment may carry ;params
PARAMS_SCHEMES = (
    "", "ftp", "http", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp",
)
# those of them that have no authority part
NO_AUTHORITY_SCHEMES = ("",)

_URI = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_PARAMS = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"
# References that need no work: an absolute path without dot segments, and a
# complete web address in canonical form.
_PLAIN_PATH = r"^/(?![/.])(?:(?!/\.)[^\x00-\x20;?#])*$"
_PLAIN_ADDRESS = (
    r"^https?://[^/?#\[\]\x00-\x20]+(?:/[^\x00-\x20;?#]*)?"
    r"(?:\?[^#\x00-\x20;]+)?(?:#[^\x00-\x20]+)?$"
)
_BAD_BRACKETS = r"^[^\[]*\]|^[^\]]*\[[^\]]*$|\[(?!v[0-9A-Fa-f]+\.[^\]]+\]|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?\])"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_parts(url: Column) -> Column:
    """Struct of scheme (lower case), netloc, path, query, fragment; '' if absent."""
    tidy = _tidy(url)

    def part(group: int) -> Column:
        return F.regexp_extract(tidy, _URI, group)

    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("netloc"),
        part(3).alias("path"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def netloc(url: Column) -> Column:
    return F.regexp_extract(_tidy(url), _URI, 2)


def _let(value: str, name: str, body: str) -> str:
    """SQL ``body`` in which ``name`` stands for a value that is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _quoted(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _parts_sql(url: str) -> str:
    names = ("scheme", "netloc", "path", "query", "fragment")
    fields = [f"regexp_extract(t, r'{_URI}', {i})" for i in range(1, 6)]
    fields[0] = f"lower({fields[0]})"
    pairs = ", ".join(f"'{name}', {field}" for name, field in zip(names, fields))
    return _let(rf"regexp_replace({url}, r'^[\x00-\x20]+|[\t\r\n]', '')", "t", f"named_struct({pairs})")


def _params_sql(scheme: str, path: str, group: int) -> str:
    otherwise = path if group == 1 else "''"
    return (
        f"if({scheme} IN ({_quoted(PARAMS_SCHEMES)}), "
        f"regexp_extract({path}, r'{_PARAMS}', {group}), {otherwise})"
    )


def _compose_sql(netloc_: str, path: str, params: str, query: str, fragment: str) -> str:
    """Address of parts; ``s`` is the scheme."""
    whole = f"if({params} <> '', concat({path}, ';', {params}), {path})"
    placed = (
        f"CASE WHEN {netloc_} <> '' THEN concat('//', {netloc_}, "
        "if(w <> '' AND NOT startswith(w, '/'), '/', ''), w) "
        "WHEN startswith(w, '//') THEN concat('//', w) "
        "WHEN s <> '' AND (w = '' OR startswith(w, '/')) THEN concat('//', w) ELSE w END"
    )
    return (
        f"concat(if(s <> '', concat(s, ':'), ''), {_let(whole, 'w', placed)}, "
        f"if({query} <> '', concat('?', {query}), ''), "
        f"if({fragment} <> '', concat('#', {fragment}), ''))"
    )


def _walk_sql(base_path: str, path: str) -> str:
    """Reference path merged into the base path, dot segments resolved."""
    head = f"split({base_path}, '/')"
    head = f"if(element_at({head}, -1) <> '', slice({head}, 1, size({head}) - 1), {head})"
    merged = _let(
        f"concat({head}, split({path}, '/'))",
        "m",
        "filter(m, (g, i) -> g <> '' OR i = 0 OR i = size(m) - 1)",
    )
    segments = f"if(startswith({path}, '/'), split({path}, '/'), {merged})"
    walked = (
        "aggregate(g, cast(array() AS array<string>), (done, x) -> "
        "CASE WHEN x = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) "
        "WHEN x = '.' THEN done ELSE array_append(done, x) END)"
    )
    ended = f"if(element_at(g, -1) IN ('.', '..'), array_append({walked}, ''), {walked})"
    joined = _let(segments, "g", f"array_join({ended}, '/')")
    return _let(joined, "j", "if(j = '', '/', j)")


def resolve_sql(base: str, reference: str, parts: str | None = None) -> str:
    """SQL text of ``resolve``, for use inside a lambda of a larger expression."""
    b = "d.b"
    r_path, r_params = (_params_sql("s", "d.r.path", group) for group in (1, 2))
    b_path, b_params = (_params_sql(f"{b}.scheme", f"{b}.path", group) for group in (1, 2))
    host = _compose_sql("d.r.netloc", r_path, r_params, "d.r.query", "d.r.fragment")
    same_page = _compose_sql(
        f"{b}.netloc", b_path, b_params, f"if(d.r.query <> '', d.r.query, {b}.query)", "d.r.fragment"
    )
    other_page = _compose_sql(
        f"{b}.netloc", _walk_sql(b_path, r_path), r_params, "d.r.query", "d.r.fragment"
    )
    general = (
        f"CASE WHEN d.r.netloc RLIKE r'{_BAD_BRACKETS}' OR {b}.netloc RLIKE r'{_BAD_BRACKETS}' THEN NULL "
        f"WHEN s <> {b}.scheme OR s NOT IN ({_quoted(RELATIVE_SCHEMES)}) THEN {reference} "
        f"WHEN s NOT IN ({_quoted(NO_AUTHORITY_SCHEMES)}) AND d.r.netloc <> '' THEN {host} "
        f"WHEN {r_path} = '' AND {r_params} = '' THEN {same_page} ELSE {other_page} END"
    )
    with_scheme = _let(f"if(d.r.scheme <> '', d.r.scheme, {b}.scheme)", "s", general)
    known = parts or "p"
    split = f"named_struct('b', {known}, 'r', {_parts_sql(reference)})"
    quick = (
        f"CASE WHEN {base} = '' THEN {reference} WHEN {reference} = '' THEN {base} "
        f"WHEN {known}.netloc NOT RLIKE r'[\\[\\]]' AND {known}.netloc <> '' "
        f"AND {known}.scheme IN ('http', 'https') AND {reference} RLIKE r'{_PLAIN_PATH}' "
        f"THEN concat({known}.scheme, '://', {known}.netloc, {reference}) "
        f"WHEN {known}.netloc NOT RLIKE r'[\\[\\]]' AND {reference} RLIKE r'{_PLAIN_ADDRESS}' "
        f"THEN {reference} ELSE {_let(split, 'd', with_scheme)} END"
    )
    return quick if parts else _let(_parts_sql(base), "p", quick)


def resolve(base: str, reference: str, parts: str | None = None) -> Column:
    """Absolute form of a reference found on a page; NULL if it cannot be read.

    The arguments are column names or SQL expressions. ``parts`` names a column with
    ``url_parts(base)`` where there is one, so that the base is split once per page.
    """
    return F.expr(resolve_sql(base, reference, parts))


def resolve_all(base: str, references: str, parts: str | None = None) -> Column:
    """The same for an array column of references."""
    return F.expr(f"transform({references}, h -> {resolve_sql(base, 'h', parts)})")


def is_web(url: Column) -> Column:
    """Starts with http:// or https:// (case-sensitive)."""
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def same_site(url: Column, base_netloc: Column, skip) -> Column:
    """Web page of the base's host without any of the skipped substrings."""
    parts = url_parts(url)
    return F.coalesce(
        parts["scheme"].isin("http", "https")
        & (parts["netloc"] == base_netloc)
        & ~contains_any(F.lower(url), skip),
        F.lit(False),
    )


def wanted(url: Column, include: Column, exclude: Column) -> Column:
    """Exclude patterns first, then at least one include pattern if there are any."""
    return ~contains_any_of(url, exclude) & (
        (F.coalesce(F.size(include), F.lit(0)) <= 0) | contains_any_of(url, include)
    )


def valid_page_url(url: Column, base: Column, include: Column, exclude: Column) -> Column:
    return same_site(url, netloc(base), DISCOVERY_SKIP) & wanted(url, include, exclude)


def valid_sitemap_url(url: Column, base: Column) -> Column:
    return same_site(url, netloc(base), SITEMAP_SKIP)


def link_matches(url: Column, words) -> Column:
    """Any of the substrings in the lower-cased URL, on any host."""
    return contains_any(F.lower(url), words)


def path_title(url: Column) -> Column:
    """Title made of the URL path; NULL for an empty path or '/'.

    The last segment's ``;params`` are not part of the path.
    """
    parts = url_parts(url)
    path = F.when(
        parts["scheme"].isin(*PARAMS_SCHEMES), F.regexp_extract(parts["path"], _PARAMS, 1)
    ).otherwise(parts["path"])
    words = F.translate(F.trim(path, F.lit("/")), "-_", "  ")
    return F.when((path != "") & (path != "/"), title_case(words))


def slash_depth(url: Column) -> Column:
    """Number of slashes less two."""
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) - 2


def is_bare_host(url: Column) -> Column:
    """URL without trailing slashes equals its own authority."""
    return F.rtrim(url, F.lit("/")) == netloc(url)


def normalise_input(
    url: Column, is_local: Column | None = None, folder: str = ""
) -> Column:
    """Address typed by a user: drop one leading @, then add what is missing.

    http, https and file addresses stay; a local path becomes a file address, a relative
    one below ``folder``; anything else gets https.
    """
    bare = F.regexp_replace(url, "^@", "")
    local = F.lit(False) if is_local is None else F.coalesce(is_local, F.lit(False))
    return (
        F.when(bare.rlike("^(?:http://|https://|file://)"), bare)
        .when(local & (F.startswith(bare, F.lit("/")) | F.lit(not folder)), F.concat(F.lit("file://"), bare))
        .when(
            local,
            F.concat(
                F.lit("file://" + folder.rstrip("/") + "/"), F.regexp_replace(bare, r"^(?:\./)+", "")
            ),
        )
        .otherwise(F.concat(F.lit("https://"), bare))
    )


def blank(text: Column) -> Column:
    """NULL, empty or only blanks."""
    return F.coalesce(strip(text) == "", F.lit(True))
