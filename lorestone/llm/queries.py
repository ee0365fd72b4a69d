"""All registered queries of this package."""

from . import contexttree, crossparse, divergence, domtrees, fixity, forest, hostrules, jaccard, mixing, packing, postorder, pretokens, sanitise
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contexttree", "crossparse", "divergence", "domtrees", "fixity", "forest", "hostrules", "jaccard", "mixing", "packing", "postorder", "pretokens", "sanitise"]
