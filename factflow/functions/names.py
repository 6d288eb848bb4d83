"""Functions over method, variable and node names. All are built-in expressions: no Python runs on executors.

Grammar: `pkg.Outer$Inner` is a class, `Class.method(T1,T2)` a method, `method#v` a variable, `method#v.f` a field of
what v points to. A null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of temporaries that contraction may remove, and what an edge type weighs.
COLLAPSIBLE = "temp_(?:void_call|alloc|call_lhs|field)_"
PRIORITY = {"PASS_ARG": 5, "PASS_RET": 4, "PASS_REC": 3, "FIELD_READ": 2, "FIELD_WRITE": 1, "COPY": 0}


def strip_signature(c: Column) -> Column:
    """The part before the first parenthesis."""
    return F.substring_index(c, "(", 1)


def signature_params(c: Column) -> Column:
    """The text between the first opening and the last closing parenthesis; empty if there is none."""
    return F.regexp_extract(c, r"(?s)^[^(]*\((.*)\)", 1)


def param_count(c: Column) -> Column:
    params = F.trim(signature_params(c))
    return F.when(params == "", 0).otherwise(F.size(F.split(params, ",")))


def first_param(c: Column) -> Column:
    """First parameter type; null if there is none."""
    first = F.trim(F.substring_index(signature_params(c), ",", 1))
    return F.when(first != "", first)


def class_of_method(c: Column) -> Column:
    """What stands before the last dot of the stripped name; all of it if there is no dot."""
    stripped = strip_signature(c)
    found = F.regexp_extract(stripped, r"(?s)^(.*)\.[^.]*$", 1)
    return F.when(F.contains(stripped, F.lit(".")), found).otherwise(stripped)


def simple_class_name(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, ".", -1), "$", -1)


def decapitalize(c: Column) -> Column:
    """Default bean name: the simple name with a small first letter."""
    s = F.substring_index(c, ".", -1)
    return F.concat(F.lower(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def field_base(c: Column) -> Column:
    """Variable of a field expression: split at the first dot after the first #; null if it is none."""
    return F.when(c.rlike(r"(?s)^[^#]*#[^.]*\."), F.regexp_extract(c, r"(?s)^([^#]*#[^.]*)\.(.*)$", 1))


def field_name(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)^[^#]*#[^.]*\."), F.regexp_extract(c, r"(?s)^([^#]*#[^.]*)\.(.*)$", 2))


def matches_boundary(cand: Column, query: Column) -> Column:
    """`cand` ends with `query`, and what precedes is nothing, a dot or a #."""
    return (cand == query) | F.endswith(cand, F.concat(F.lit("."), query)) | F.endswith(cand, F.concat(F.lit("#"), query)) | ((query == "") & F.endswith(cand, F.lit("."))) | ((query == "") & F.endswith(cand, F.lit("#")))


def matches_method(cand: Column, query: Column) -> Column:
    """A method matches a query by name alone, with `()` only without parameters, or with the parameters given."""
    c, q = F.replace(cand, F.lit(" "), F.lit("")), F.replace(query, F.lit(" "), F.lit(""))
    prefix = strip_signature(c)
    params = F.concat(F.lit("("), F.regexp_extract(q, r"(?s)^[^(]*\((.*)$", 1))
    return (
        F.when(F.endswith(q, F.lit("()")), F.endswith(c, F.lit("()")) & matches_boundary(prefix, q.substr(F.lit(1), F.length(q) - 2)))
        .when(F.contains(q, F.lit("(")), F.endswith(c, params) & matches_boundary(prefix, strip_signature(q)))
        .otherwise(matches_boundary(prefix, q))
    )


def _before_last_hash(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*)#[^#]*$", 1)


def matches_node(cand: Column, query: Column) -> Column:
    """A lineage node matches `method#var` on both parts, or else by whole, by variable, by field or by method."""
    c, q = F.replace(cand, F.lit(" "), F.lit("")), F.replace(query, F.lit(" "), F.lit(""))
    hashed = F.contains(c, F.lit("#"))
    both = hashed & (F.substring_index(c, "#", -1) == F.substring_index(q, "#", -1)) & matches_method(_before_last_hash(c), _before_last_hash(q))
    plain = (c == q) | F.endswith(c, F.concat(F.lit("#"), q)) | F.endswith(c, F.concat(F.lit("."), q)) | (hashed & matches_method(_before_last_hash(c), q))
    return F.when(F.contains(q, F.lit("#")), both).otherwise(plain)


def simple_name(c: Column) -> Column:
    """After the first #; without one, after the last dot."""
    return F.when(F.contains(c, F.lit("#")), F.regexp_extract(c, r"(?s)^[^#]*#(.*)$", 1)).otherwise(F.substring_index(c, ".", -1))


def is_collapsible(c: Column) -> Column:
    return c.rlike(f"^{COLLAPSIBLE}") | F.substring_index(c, "#", -1).rlike(f"^{COLLAPSIBLE}")


def edge_priority(c: Column) -> Column:
    out = F.lit(-1)
    for name, p in PRIORITY.items():
        out = F.when(c == name, p).otherwise(out)
    return out


def combine_paths(base: Column, path: Column) -> Column:
    """A route's path: both parts get a leading slash, single slashes between, none at the end; `/` if nothing is left."""

    def part(c: Column) -> Column:
        t = F.trim(c)
        led = F.when(F.startswith(t, F.lit("/")), t).otherwise(F.concat(F.lit("/"), t))
        return F.when(t == "", "").otherwise(F.when((F.length(led) > 1) & F.endswith(led, F.lit("/")), led.substr(F.lit(1), F.length(led) - 1)).otherwise(led))

    full = F.regexp_replace(F.concat(part(base), part(path)), "/+", "/")
    cut = F.when((F.length(full) > 1) & F.endswith(full, F.lit("/")), full.substr(F.lit(1), F.length(full) - 1)).otherwise(full)
    return F.when(cut == "", "/").otherwise(cut)


def annotation_paths(args: Column) -> Column:
    """Array of the paths in a mapping's arguments: every quoted string, else the bare text, else one empty path."""
    t = F.trim(F.coalesce(args, F.lit("")))
    cut = F.when(t.rlike("^(?:value|path)[^=]*="), F.trim(F.regexp_replace(t, r"(?s)^(?:value|path)[^=]*=", ""))).otherwise(t)
    quoted = F.transform(F.regexp_extract_all(cut, F.lit(r"""("[^"]*"|'[^']*')"""), F.lit(1)), lambda x: x.substr(F.lit(2), F.length(x) - 2))
    return F.when(F.size(quoted) > 0, quoted).otherwise(F.array(F.trim(F.regexp_replace(cut, r"[{}\"']", ""))))


def http_methods(name: Column, args: Column) -> Column:
    """Array of HTTP methods of a mapping annotation."""
    upper = F.upper(F.coalesce(args, F.lit("")))
    verbs = ["GET", "POST", "PUT", "DELETE", "PATCH"]
    found = F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(f"REQUESTMETHOD.{v}")), F.lit(v)) for v in verbs]))
    out = F.when((name == "RequestMapping") & (F.size(found) > 0), found).otherwise(F.array(F.lit("ANY")))
    for v in verbs:
        out = F.when(name == f"{v.capitalize()}Mapping", F.array(F.lit(v))).otherwise(out)
    return out


def unquoted(c: Column) -> Column:
    t = F.trim(c)
    quoted = (F.length(t) > 1) & ((F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'"))))
    return F.when(quoted, F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def placeholder(c: Column) -> Column:
    """struct(key, fallback, literal) of an annotation value: `${key:default}`, `${key}` or a literal (then key is null)."""
    s = unquoted(c)
    inside = F.regexp_extract(s, r"(?s)^\$\{(.*)\}$", 1)
    is_one = s.rlike(r"(?s)^\$\{.*\}$")
    key = F.trim(F.substring_index(inside, ":", 1))
    default = F.when(F.contains(inside, F.lit(":")), F.trim(F.regexp_extract(inside, r"(?s)^[^:]*:(.*)$", 1)))
    return F.struct(F.when(is_one, key).alias("key"), F.when(is_one, F.coalesce(default, key)).alias("fallback"), F.when(~is_one, s).alias("literal"))


def matches_within(method: Column, pattern: Column) -> Column:
    """`p..*`, `p.*`, `p*`: the method is p or lies under it; otherwise the method or its class is p."""
    p, m = F.trim(pattern), strip_signature(method)
    prefix = F.regexp_replace(p, r"(?:\.\.\*|\.\*|\*)$", "")
    under = (m == prefix) | F.startswith(m, F.concat(prefix, F.lit(".")))
    return F.when(F.endswith(p, F.lit("*")), under).otherwise((m == p) | (F.contains(m, F.lit(".")) & (class_of_method(m) == p)))


def pointcut_patterns(expr: Column) -> Column:
    """Array of the patterns of a pointcut: `within(P)` and `execution(... P(..))`, split at `||`; others give none."""

    def one(part: Column) -> Column:
        t = F.trim(part)
        within = F.when(t.rlike(r"(?s)^within\(.*\)$"), F.regexp_extract(t, r"(?s)^within\((.*)\)$", 1))
        inside = F.trim(F.regexp_extract(t, r"(?s)^execution\((.*)\)$", 1))
        last = F.regexp_extract(inside, r"(\S+)$", 1)
        execution = F.when(t.rlike(r"(?s)^execution\(.*\)$") & (inside != ""), F.substring_index(last, "(", 1))
        return F.coalesce(within, execution)

    return F.array_compact(F.transform(F.split(expr, r"\|\|"), one))
