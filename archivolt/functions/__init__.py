"""archivolt package."""
