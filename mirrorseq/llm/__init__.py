"""Operators for building training corpora: one module each, with the
registered queries in :mod:`mirrorseq.llm.queries`.  Nothing else in the
library imports this subpackage."""
