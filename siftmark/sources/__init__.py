"""Where documents, models and cached vectors come from, and how hits go out."""
