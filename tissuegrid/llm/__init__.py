"""Operators for training-data pipelines over event texts, tiles and cohorts; nothing else imports them."""
