"""Column functions: text analysis, chunking, stemming, ranking arithmetic."""
