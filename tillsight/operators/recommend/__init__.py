"""Recommenders. ``fit(transactions)`` gives a model; ``model.recommend(customers, n)`` gives the long table
``(masked_customer_id, rank, business_name, business_town, score)``, score null for filled-up places."""

from tillsight.operators.recommend.base import Popular, RandomOrder, Recommender
from tillsight.operators.recommend.ensemble import Ensemble
from tillsight.operators.recommend.factors import ImplicitFactors
from tillsight.operators.recommend.items import ItemToItem
from tillsight.operators.recommend.neighbours import NearestCustomers, NeighbourToItem

__all__ = ["Ensemble", "ImplicitFactors", "ItemToItem", "NearestCustomers", "NeighbourToItem", "Popular",
           "RandomOrder", "Recommender"]
