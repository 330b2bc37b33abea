"""References resolved against the page they stand on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Scheme, authority with its slashes, path, query with its mark, fragment with its mark.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
ANCHOR = r"(?is)<a\s[^<>]*>.*?</a\s*>"
HREF = r"""(?is)^<a\s(?:[^<>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""


def without_dots(path: Column) -> Column:
    """A path without . and .. segments; .. at the top goes away."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, 1, F.greatest(F.lit(1), F.size(held) - 1))).otherwise(F.concat(held, F.array(s))))
    return F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def encoded(c: Column) -> Column:
    """Spaces, quotes, angle brackets, controls and all beyond ASCII in percent form; what is encoded stays."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.regexp_like(x, F.lit(r"""[^\x21-\x7E]|["<>]""")), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)), "")


def absolute(ref: Column, base: Column) -> Column:
    """The address that ref stands for on the page base: other schemes as they are, all else with scheme and host in lower case and without dot segments. Null if either is null or base has no scheme."""
    part = lambda c, k: F.regexp_extract(c, PARTS, k)
    said = F.trim(F.regexp_replace(ref, "[\t\n\r]", ""))
    own_scheme, own_host = F.lower(part(said, 1)), part(said, 2)
    scheme = F.when(own_scheme != "", own_scheme).otherwise(F.lower(part(base, 1)))
    here = (own_scheme == "") & (own_host == "")
    host = F.lower(F.when(here, part(base, 2)).otherwise(own_host))
    path, old = part(said, 3), part(base, 3)
    folder = F.regexp_replace(old, "[^/]*$", "")
    joined = F.when(~here | F.startswith(path, F.lit("/")), path).when(path == "", old).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    query = F.when(here & (path == "") & (part(said, 4) == ""), part(base, 4)).otherwise(part(said, 4))
    whole = F.concat(scheme, F.lit(":"), host, encoded(F.coalesce(F.nullif(without_dots(joined), F.lit("")), F.lit("/"))), encoded(query), encoded(part(said, 5)))
    opaque = (own_scheme != "") & (own_host == "")
    return F.when(F.regexp_like(base, F.lit(SCHEME)), F.when(opaque, said).otherwise(whole))


def anchors(html: Column) -> Column:
    """The link elements of a page that have an address, in order."""
    return F.filter(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.regexp_like(a, F.lit(HREF)))


def address(anchor: Column) -> Column:
    return F.concat(*[F.regexp_extract(anchor, HREF, k) for k in (1, 2, 3)])
