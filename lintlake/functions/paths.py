"""Path expressions: layers, tags, globs, routes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.catalog import layers as L
from lintlake.functions.lookup import contains_any, ends_with_any, first_match, literal_array, starts_with_any


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """'.ts' of 'a/b.test.ts'; '' when the name has none (a leading dot does not count)."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def normal_path(path: Column) -> Column:
    """Resolve '.', 'x/..' and doubled slashes, keeping a relative path relative."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(
            (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(part))))
    return F.array_join(resolved, "/")


def under_any_dir(path: Column, names) -> Column:
    """True when one of the directories of the path has one of the names."""
    dirs = F.split(path, "/")
    return F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))),
                            literal_array(names))


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex; as in fnmatch, '*' also crosses '/'."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "_/-" else "\\" + ch)
    return "^" + "".join(out) + "$"


def layer(path: Column, stack: Column) -> Column:
    """First layer whose fragments occur in the lower-cased path, the stack's own list first."""
    lower = F.lower(path)
    cases = []
    for name, table in L.STACK_LAYERS.items():
        cases += [((stack == name) & contains_any(lower, marks), found) for found, marks in table.items()]
    cases += [(contains_any(lower, marks), found) for found, marks in L.GENERIC_LAYERS.items()]
    return first_match(cases, L.DEFAULT_LAYER)


def wanted(path: Column, stack: Column) -> Column:
    """Files the inventory keeps: the stack's extensions, outside pruned directories."""
    known = [s for s in L.STACK_EXTENSIONS if s != "unknown"]
    test = ~stack.isin(known) & ends_with_any(path, L.STACK_EXTENSIONS["unknown"])
    for name in known:
        test = test | ((stack == name) & ends_with_any(path, L.STACK_EXTENSIONS[name]))
    return test & ~under_any_dir(path, L.PRUNED_DIRS)


def language(path: Column) -> Column:
    """Code-block language of a file."""
    return first_match([
        (ends_with_any(path, [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]), "ts"),
        (path.endswith(".py"), "python"),
        (ends_with_any(path, [".java", ".kt", ".kts"]), "java"),
        (path.endswith(".go"), "go"),
    ], "")


def nominal(path: Column, loc: Column, authority=()) -> Column:
    """Tiny files, unless they lie under an authority prefix."""
    return (loc < L.NOMINAL_LOC) & ~starts_with_any(path, authority)


# What a file serves at run time; first match wins.
RUNTIME_KINDS = [
    (r"(^|/)app/(.*/)?page\.(tsx|ts|jsx|js)$", "page", "nextjs"),
    (r"(^|/)src/routes/(.*/)?\+page\.(svelte|ts)$", "page", "sveltekit"),
    (r"(^|/)app/(.*/)?route\.(tsx|ts|jsx|js)$", "api", "nextjs-api"),
    (r"(^|/)pages/(?!api/).*\.(tsx|ts|jsx|js|vue)$", "page", "pages-router"),
    (r"(^|/)pages/api/.*\.(ts|js)$", "api", "pages-api"),
]


def runtime_kind(path: Column) -> tuple[Column, Column]:
    """(kind, framework) of a file, both null when it serves nothing."""
    kinds = [(path.rlike(p), F.lit(kind)) for p, kind, _ in RUNTIME_KINDS]
    names = [(path.rlike(p), F.lit(name)) for p, _, name in RUNTIME_KINDS]
    nothing = F.lit(None).cast("string")
    return first_match(kinds, nothing), first_match(names, nothing)


def route(path: Column, framework: Column) -> Column:
    """The URL path a page or endpoint answers on; '/' for the root, null when unknown."""
    app = F.regexp_replace(F.regexp_replace(path, r"^(src/)?app", ""), r"/(page|route)\.(tsx|ts|jsx|js)$", "")
    pages = F.regexp_replace(F.regexp_replace(path, r"^(src/)?pages", ""),
                             r"(/index)?\.(tsx|ts|jsx|js|vue)$", "")
    svelte = F.regexp_replace(F.regexp_replace(path, r"^.*/?src/routes", ""), r"/\+page\.(svelte|ts)$", "")
    found = (F.when(framework.isin("nextjs", "nextjs-api"), app)
             .when(framework.isin("pages-router", "pages-api"), pages)
             .when(framework == "sveltekit", svelte))
    return F.when(found == "", "/").otherwise(found)
