"""newsquant: news-event and market-price analytics expressed as Spark jobs."""
