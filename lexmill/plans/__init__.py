"""All queries of the library by name, and the SQL that states their results."""

from lexmill.plans import corpus, dialogue, flow, retrieval

QUERIES = retrieval.QUERIES | corpus.QUERIES | dialogue.QUERIES | flow.QUERIES
SQL = retrieval.SQL | corpus.SQL | dialogue.SQL | flow.SQL
