"""DataFrame -> DataFrame operators (vocabulary, pooling, context, annotation, evaluation, models)."""
