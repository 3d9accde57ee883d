"""huntframe: log hunting and corpus jobs as plain PySpark DataFrame transforms."""
