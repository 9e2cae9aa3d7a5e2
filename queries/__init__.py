"""The registered queries, by area; each module has QUERIES and ORACLES."""

from queries import answers, conforming, dictionary, mapping, matching

REGISTERED = (matching, mapping, dictionary, conforming, answers)
