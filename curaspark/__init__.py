"""curaspark: curation of detections, embeddings and documents on Spark."""
