"""Catalogue, settings, the engine facade and the registered queries."""
