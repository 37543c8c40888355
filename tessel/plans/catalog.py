"""All registered queries and their SQL."""

from tessel.plans import clustering, lists, more, similarity, stored

PARTS = [similarity, lists, clustering, more, stored]
QUERIES: dict = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLES: dict = {k: s for part in PARTS for k, s in part.ORACLES.items()}
