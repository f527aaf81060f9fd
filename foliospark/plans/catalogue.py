"""The modules that register queries; importing this one fills the registry."""

from . import q_corpus, q_graph, q_retrieval  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
