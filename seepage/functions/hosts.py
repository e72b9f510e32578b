"""Host and URL expressions."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.pieces import pieces
from seepage.functions.text import _col, let, strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def clean_domain(c) -> Column:
    """Lower case, trimmed, without scheme, path and port."""
    bare = F.regexp_replace(strip(F.lower(_col(c))), r"^https?://", "")
    return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def strip_wildcard(c) -> Column:
    c = _col(c)
    return F.when(F.startswith(c, F.lit("*.")), F.substr(c, F.lit(3))).otherwise(c)


def first_label(c) -> Column:
    return F.split_part(_col(c), F.lit("."), F.lit(1))


def belongs_to(host, target) -> Column:
    """The target itself or a host below it."""
    return F.endswith(F.concat(F.lit("."), _col(host)), F.concat(F.lit("."), _col(target)))


def url_host(c) -> Column:
    """Lower-case host of a URL, null where there is none."""
    return F.lower(F.try_parse_url(_col(c), F.lit("HOST")))


def url_authority(c) -> Column:
    """Host with user and port, as far as the URL has them."""
    return F.lower(F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def link_host(c, tld: str) -> Column:
    """Host of an absolute or bare link if it ends with the given suffix, else null."""
    c = _col(c)
    host = F.when(F.startswith(c, F.lit("http")), url_authority(c)).otherwise(F.split_part(c, F.lit("/"), F.lit(1)))
    return F.when(F.endswith(host, F.lit(tld)), host)


def suffixes(host) -> Column:
    """The host and every parent: a.b.c gives a.b.c, b.c, c."""

    def tails(labels):
        n = F.size(labels)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))

    return let(F.split(_col(host), r"\."), tails)


def splits(host) -> Column:
    """Every way to cut a host at a dot into ``head`` and ``tail``."""

    def cuts(labels):
        n = F.size(labels)
        cut = lambda i: F.struct(
            F.array_join(F.slice(labels, F.lit(1), i), ".").alias("head"),
            F.array_join(F.slice(labels, i + 1, n), ".").alias("tail"),
        )
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), cut))

    return let(F.split(_col(host), r"\."), cuts)


def cut_prefixes(name) -> Column:
    """The name and every beginning of it that ends before a '.' or '-'."""
    mark = "\u0001"

    def heads(pieces):
        return F.transform(
            F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "")
        )

    return let(F.split(F.regexp_replace(_col(name), "([.-])", f"{mark}$1"), mark), heads)


def url_root(c) -> Column:
    """Scheme, host, user and port of a URL as written, '' where there is none."""
    return F.regexp_extract(_col(c), r"^((?:https?|ftp)://[^/?#]+)", 1)


def plain_urls(base, links) -> Column:
    """The links that need no resolving as absolute URLs, null for the others.

    These are plain absolute links, and plain root-relative ones on a page
    with a scheme and host.
    """
    links = _col(links)
    is_plain = lambda u: u.rlike(r"^(https?|ftp)://[^/?#\s\[\]]+(/[^.?#\s]*)?$")
    is_rooted = lambda u: u.rlike(r"^/([^/.?#\s][^.?#\s]*)?$")

    def ready(root):
        return F.transform(
            links, lambda u: F.when(is_plain(u), u).when(is_rooted(u) & (root != ""), F.concat(root, u))
        )

    return let(url_root(base), ready)


@F.arrow_udf(T.ArrayType(T.StringType()))
def join_urls(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Links of a page resolved against its URL; null stays null, as does a link that cannot be resolved."""

    def joined(b, u):
        try:
            return urljoin(b or "", u)
        except ValueError:
            return None

    for batch in batches:
        for base, links in pieces(batch):
            found = links.flatten()
            if found.null_count < len(found):
                given = found.is_valid()
                bases = base.take(pc.list_parent_indices(links).filter(given)).to_pylist()
                done = pa.array([joined(b, u) for b, u in zip(bases, found.filter(given).to_pylist())], pa.string())
                found = pc.replace_with_mask(found, given, done)
            ends = np.cumsum(pc.list_value_length(links).fill_null(0).to_numpy(), dtype=np.int32)
            offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[links.is_null().to_numpy(zero_copy_only=False), False])
            yield pa.ListArray.from_arrays(offsets, found)
