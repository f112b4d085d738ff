"""All registered queries."""

from workbench import q_cleaning, q_establishments, q_finance, q_incidence, q_layers, q_spatial  # noqa: F401
from workbench.kit import ORACLE, QUERIES  # noqa: F401
