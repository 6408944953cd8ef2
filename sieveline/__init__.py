"""sieveline: message-risk analytics and corpus preparation on Spark DataFrames."""
