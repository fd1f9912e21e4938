"""Schemas of the data model, stated rather than inferred."""

from __future__ import annotations

SPLIT_ROW = "reaction_id string, reactants string, product string, yield string, reagent string, solvent string, temperature string"
ROUTE = "reactants string, retro_rank int, retro_score double, retro_probability double"
ROUTE_CACHE = (
    "family string, checkpoint string, generation_file string, aug int, topk int, n_best int, num_reactions int, "
    f"reactions array<struct<sample_index: int, reaction_id: string, product: string, gold_reactants: string, "
    "routes: array<struct<reactants: string, retro_rank: int, retro_score: double, retro_probability: double>>>>"
)
# Columns kept of a raw export.
RAW_COLUMNS = (
    "Reaction ID", "Reaction", "Temperature (Reaction Details) [C]", "Yield (numerical)", "Reagent", "Catalyst", "Solvent (Reaction Details)", "Number of Reaction Steps",
)
