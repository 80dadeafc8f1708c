"""All queries of the library beside the training-data operators, and the SQL that each is held against."""

from scholium.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES
from scholium.plans import corpus, exchange, gold, reports, significance, structure, values

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "corpus", "exchange", "gold", "reports", "significance", "structure", "values"]
