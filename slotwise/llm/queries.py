"""All registered queries of this subpackage and their SQL."""

from . import fim, langid, ngrams, packing, periods, pieces, pii, quality, rans, simhash, sketches, topk, warc  # noqa: F401
from .common import ORACLE, QUERIES  # noqa: F401
