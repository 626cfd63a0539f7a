"""DataFrame operators: chunking, lexical and dense search, fusion, context, answers, overviews, layout, store."""
