"""Whole plans: entity resolution, model training, training data, gazetteer builds."""
