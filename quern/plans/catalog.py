"""All registered queries and the DuckDB SQL that each is compared with."""

from quern.plans import evaluation, experiments, samples, similarity

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (evaluation, samples, similarity, experiments):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
