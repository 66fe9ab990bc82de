"""Sources: stored documents, and the tables that stand for the roles of a document gateway."""
