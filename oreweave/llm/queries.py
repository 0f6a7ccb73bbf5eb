"""All registered queries of this subpackage."""

from . import alignment, bpe, covertree, language, licenses, lm, minhash, multiindex, packing, pseudonyms, quality, repeats, whitening  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
