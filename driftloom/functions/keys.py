"""Registry keys and host keys from URLs.

Regular expressions instead of ``parse_url``: the latter gives NULL for URLs it finds
malformed (a blank in the path, for one), and every page must get a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Network location of the URL, empty when it has none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def url_pattern(url: Column) -> Column:
    """Host and path; scheme, query, fragment, last-segment parameters and closing slashes dropped."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")
    return F.regexp_replace(F.concat(host(url), path), r"/+$", "")


def registry_key(url: Column, schema_name: Column) -> Column:
    """``schema:first twelve hex digits of md5(pattern)``."""
    return F.concat(schema_name, F.lit(":"), F.left(F.md5(url_pattern(url)), F.lit(12)))
