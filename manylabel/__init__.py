"""manylabel: multi-label enrichment of weakly labelled text catalogues on PySpark."""

from manylabel.session import build_session, stage

__all__ = ["build_session", "stage"]
