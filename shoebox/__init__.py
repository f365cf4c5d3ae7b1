"""Spark jobs for curating picture collections: catalog, search, clustering and their evaluation."""
