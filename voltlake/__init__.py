"""Lake analytics as Spark jobs: cleansing, quality, features, drift, forecasting, risk, cost and operations."""
