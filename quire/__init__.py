"""quire: Spark jobs for catalogues of serialised text (works made of ordered sections)."""
