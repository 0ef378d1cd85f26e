"""Sources: station CSV dialects, hotspot files, wide hourly files and binary concentration dumps."""
