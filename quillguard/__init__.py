"""Find, locate, de-duplicate, mask and audit personal data over dossiers of documents, on Spark."""
