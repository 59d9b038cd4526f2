"""All named queries and their SQL."""

from sedge.plans import application, blocks, cleaning, evidence, grounding, private, relational, textual

QUERIES = relational.QUERIES | textual.QUERIES | private.QUERIES | application.QUERIES | evidence.QUERIES | cleaning.QUERIES | grounding.QUERIES | blocks.QUERIES
ORACLE_SQL = relational.SQL | textual.SQL | private.SQL | application.SQL | evidence.SQL | cleaning.SQL | grounding.SQL | blocks.SQL
