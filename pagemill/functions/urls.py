"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 split of a reference: scheme, authority, path, query, fragment.
URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def _kept(prefix: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value)).otherwise("")


def drop_default_port(authority: Column, scheme_: Column) -> Column:
    """Anchored at the end, so host:8080 keeps its port."""
    return (
        F.when(scheme_ == "http", F.regexp_replace(authority, ":80$", ""))
        .when(scheme_ == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    )


def sorted_query(q: Column) -> Column:
    """Parameters by key; repeated keys keep their order, blanks are kept."""
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    indexed = F.transform(pairs, lambda p, i: F.struct(
        F.substring_index(p, "=", 1).alias("k"), i.alias("i"),
        F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    # array_sort orders structs field by field: key, then first position
    return F.array_join(F.transform(F.array_sort(indexed), lambda s: s["p"]), "&")


def normalize_url(url: Column) -> Column:
    """Lower scheme and host, no default port, '/' as empty path, sorted query, no fragment."""
    u = F.trim(url)
    s = F.coalesce(F.nullif(scheme(u), F.lit("")), F.lit("https"))
    authority = drop_default_port(host(u), s)
    p = F.coalesce(F.nullif(path(u), F.lit("")), F.lit("/"))
    return F.concat(s, F.lit("://"), authority, p, _kept("?", sorted_query(query(u))))


def strip_slash_url(url: Column) -> Column:
    """Fragment and trailing slash (not the root's) removed."""
    p = F.regexp_replace(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), "(.)/$", "$1")
    return F.concat(scheme(url), F.lit("://"), host(url), p, _kept("?", query(url)))


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def same_domain(left: Column, right: Column) -> Column:
    return host(left) == host(right)


def _remove_dots(p: Column) -> Column:
    """'.' and '..' segments resolved as in RFC 3986, only where present."""
    pieces = F.split(p, "/")

    def step(acc: Column, piece: Column) -> Column:
        # the first piece of an absolute path is the empty text before '/'
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(piece == "..", up).when(piece == ".", acc).otherwise(F.concat(acc, F.array(piece)))

    folded = F.aggregate(pieces, F.array().cast("array<string>"), step)
    tail = F.when(p.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise("")
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(p)


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 join as an expression, no Python."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    ref_tail = F.concat(_kept("?", query(ref)), _kept("#", part(ref, 5)))
    rel_path = path(ref)
    return (
        F.when(part(ref, 1) != "", ref)
        .when(part(ref, 2) != "", F.concat(part(base, 1), F.lit(":"), ref))
        .when(rel_path.startswith("/"), F.concat(origin, _remove_dots(rel_path), ref_tail))
        .when((rel_path == "") & (query(ref) != ""), F.concat(origin, path(base), ref_tail))
        .when(rel_path == "", F.concat(origin, path(base), _kept("?", query(base)), _kept("#", part(ref, 5))))
        .otherwise(F.concat(origin, _remove_dots(F.concat(folder, rel_path)), ref_tail))
    )


def first_rule(url: Column, rules: list[dict], fields: list[str], default: dict) -> Column:
    """Struct of the first rule whose pattern is found; rules fold into one CASE.

    Rule lists are configuration of tens of rows, so no join is needed at all.
    """
    def as_struct(rule: dict) -> Column:
        return F.struct(*[F.lit(rule[f]).alias(f) for f in fields])

    chain = None
    for rule in rules:
        test, value = url.rlike(rule["pattern"]), as_struct(rule)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(as_struct(default)) if chain is not None else as_struct(default)


# Patterns of the path classifier, in order of precedence.
PATH_RULES = (
    ("integration", r"/integrations/[^/]+/?$|/integrations/builtin/[^/]+/?$|/integrations/community-nodes/[^/]+/?$"),
    ("code_example", r"/code/[^/]+/?$|/code/examples/[^/]+/?$|/workflows/[^/]+/?$"),
    ("api_reference", r"/api/[^/]+/?$|/reference/[^/]+/?$"),
    ("tutorial", r"/tutorials/[^/]+/?$|/getting-started/[^/]+/?$|/courses/[^/]+/?$"),
)
PATH_FALLBACKS = (("documentation", "/docs/"), ("blog_post", "/blog/"), ("forum_post", "/community/"))


def classify_path(url: Column) -> Column:
    p = F.lower(path(url))
    label = F.when(p.rlike(PATH_RULES[0][1]), PATH_RULES[0][0])
    for name, pattern in PATH_RULES[1:]:
        label = label.when(p.rlike(pattern), name)
    for name, piece in PATH_FALLBACKS:
        label = label.when(p.contains(piece), name)
    return label.otherwise("general")


# Site types by substring, in order; own sites are passed in.
SITE_TYPES = (
    ("documentation", ("/docs/", "/documentation/", "/guide/", "/manual/")),
    ("api_docs", ("/api/", "/reference/")),
    ("blog", ("/blog/", "/post/", "/article/")),
)


def site_type(url: Column, own_sites: tuple[str, ...] = ()) -> Column:
    low = F.lower(url)
    label = F.when(_any(low, own_sites), "own")
    for name, pieces in SITE_TYPES:
        label = label.when(_any(low, pieces), name)
    return label.otherwise("generic")


def _any(c: Column, pieces) -> Column:
    test = F.lit(False)
    for piece in pieces:
        test = test | c.contains(piece)
    return test


# Switches of the path filter and their path pieces.
CONTENT_SWITCHES = (
    ("integrations", ("/integrations/",)), ("code_examples", ("/code/", "/workflows/")), ("api_docs", ("/api/", "/reference/")),
    ("tutorials", ("/tutorials/", "/getting-started/")), ("changelog", ("/changelog/",)), ("blog", ("/blog/",)), ("community", ("/community/",)),
)
EXCLUDED_PATHS = ("/blog/", "/search", "/404", "/login", "/signup")


def path_allowed(url: Column, excluded=EXCLUDED_PATHS, off=("changelog", "blog", "community")) -> Column:
    p = F.lower(path(url))
    blocked = [piece.lower() for piece in excluded]
    for name, pieces in CONTENT_SWITCHES:
        if name in off:
            blocked.extend(pieces)
    return ~_any(p, blocked)


# File suffixes and paths never fetched.
SKIPPED_FILES = r"(?i)\.(pdf|zip|tar|gz|exe|dmg|jpg|jpeg|png|gif|svg|css|js|ico|woff|woff2|ttf)$"
SKIPPED_PATHS = r"/api/|/search|/_|#"


def domain_and_type_allowed(url: Column, domain_test: Column) -> Column:
    return domain_test & ~url.rlike(SKIPPED_FILES) & ~url.rlike(SKIPPED_PATHS)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


# First segments whose second segment refines the category.
REFINED_SEGMENTS = (
    ("integrations", ("builtin", "creating-nodes")), ("hosting", ("installation", "configuration", "architecture")), ("code", ("cookbook", "builtin")),
)


def category(url: Column) -> Column:
    parts = path_parts(url)
    one, two = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    label = F.when(F.size(parts) == 0, "root")
    for first, seconds in REFINED_SEGMENTS:
        label = label.when((one == first) & two.isin(*seconds), F.concat_ws("_", one, two)).when(one == first, F.lit(first))
    label = label.when((one == "release-notes") & (two == "0-x"), "release_notes_legacy")
    return label.otherwise(F.replace(one, F.lit("-"), F.lit("_")))


def subcategory(url: Column) -> Column:
    return F.replace(F.try_element_at(path_parts(url), F.lit(3)), F.lit("-"), F.lit("_"))


def first_segment(url: Column, site_prefix: str) -> Column:
    rest = F.replace(url, F.lit(site_prefix), F.lit(""))
    head = F.split_part(rest, F.lit("/"), F.lit(1))
    return F.when(head == "", "root").otherwise(head)


# Document type by path piece, in order.
DOC_TYPES = (
    ("/nodes/", "node_docs", "nodes"), ("/workflows/", "workflow", "workflows"), ("/tutorials/", "tutorial", "tutorials"),
    ("/integrations/", "integration", "integrations"), ("/api/", "api_docs", "api"),
)


def doc_type(url: Column) -> tuple[Column, Column]:
    kind = cat = None
    for piece, k, c in DOC_TYPES:
        test = url.contains(piece)
        kind = F.when(test, k) if kind is None else kind.when(test, k)
        cat = F.when(test, c) if cat is None else cat.when(test, c)
    return kind.otherwise("node_docs"), cat.otherwise("general")


def document_id(url: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws("_", url, kind))


def output_name(url: Column) -> Column:
    """Flat file name: slashes to underscores, 'index' for the root."""
    flat = F.regexp_replace(F.replace(path(url), F.lit("/"), F.lit("_")), "^_+|_+$", "")
    return F.concat(F.regexp_replace(F.when(flat == "", "index").otherwise(flat), r'[<>:"/\\|?*]', "_"), F.lit(".json"))


def output_path(url: Column) -> Column:
    """Folder-keeping file name with a markdown suffix."""
    p = F.regexp_replace(path(url), "^/", "")
    return F.when(p == "", "index.md").when(p.endswith("/"), F.concat(p, F.lit("index.md"))).otherwise(F.concat(p, F.lit(".md")))


# File suffix per asset type when the URL has none.
ASSET_SUFFIX = {"image": ".png", "stylesheet": ".css", "font": ".woff"}


def asset_filename(url: Column, kind: str) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    suffix = F.regexp_extract(last, r".(\.[^.]*)$", 1)
    stem = F.when(suffix == "", last).otherwise(F.substring(last, F.lit(1), F.length(last) - F.length(suffix)))
    return F.concat(
        F.when(stem == "", "asset").otherwise(stem), F.lit("_"), F.substring(F.md5(url), 1, 8),
        F.when(suffix == "", ASSET_SUFFIX.get(kind, ".bin")).otherwise(suffix))


HREF_PATTERNS = tuple(rf"""(?i){a}=["']([^"'>]+)["']""" for a in ("href", "src", "action"))


def urls_in_markup(html: Column, base: Column) -> Column:
    """href, then src, then action targets; resolved, normalized, first one kept."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in HREF_PATTERNS])
    kept = F.filter(found, lambda h: ~h.rlike(r"^(#|javascript:|mailto:)"))
    return F.array_distinct(F.transform(kept, lambda h: normalize_url(resolve_url(base, h))))
